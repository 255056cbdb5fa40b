"""Command line: train, test, and write settings."""

from __future__ import annotations

import argparse
import json
import sys

from .config import DEFAULTS, Config


def parsed(arguments: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="beaconry", description=__doc__)
    p.add_argument("task", choices=("train", "test", "config", "template", "datasets", "explain"))
    p.add_argument("--config", help="settings file (YAML or JSON)")
    p.add_argument("--root", help="folder of the dataset's files")
    p.add_argument("--model", help="folder of the model")
    p.add_argument("--out", help="folder of the results")
    p.add_argument("--show", action="store_true", help="lay the result beside published ones")
    p.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="a setting by its dotted key; values are literals")
    return p.parse_args(arguments)


def settings(args: argparse.Namespace) -> Config:
    base = Config.from_file(args.config) if args.config else Config(DEFAULTS)
    return base.overridden(dict(s.split("=", 1) for s in args.set))


def template(told: Config, out: str | None) -> dict:
    """Settings that may be edited, with a note for each; written to ``out`` as JSON if it is given."""
    from .sources import dataset_info

    spec = dataset_info(told.get("dataset.type"))
    made = told.to_dict() | {"_notes": {
        "dataset.type": "a dataset's name or alias", "dataset.normalize_method": "minmax, positive or standard, as the signal allows",
        "dataset.filters": f"values by column: {', '.join(spec['filters']) or 'none here'}", "model.type": "knn, wknn, deep or auto", "model.k": "neighbours", "metrics": "names of metrics",
    }}
    if out:
        with open(out, "w", encoding="utf-8") as f:
            json.dump(made, f, indent=2)
    return made


def explained(told: Config) -> dict:
    """What a run would do: the dataset's files and marker, the model's settings, and the best published results."""
    from .operators.leaderboard import rows
    from .registry import LOCALIZERS
    from .sources import dataset_info

    from . import models  # noqa: F401  registers the locators

    spec, model = dataset_info(told.get("dataset.type")), told.to_dict().get("model", {})
    best = sorted((r for r in rows() if r[0] == spec["name"]), key=lambda r: (r[2], r[-1]))[:3]
    return {
        "dataset": spec, "model": model, "known_models": LOCALIZERS.names(),
        "steps": ["load both splits", "scale by signal", "keep the fingerprints", "find each query's k nearest", "weigh positions and labels", "measure errors"],
        "published": [{"method": r[1], "mean_error": r[2], "source": r[6]} for r in best],
    }


def run(args: argparse.Namespace) -> dict | list:
    """What a task tells: settings, names, or figures."""
    from .sources import list_datasets

    if args.task == "datasets":
        return list_datasets()
    told = settings(args)
    if args.task == "template":
        return template(told, args.out)
    if args.task == "explain":
        return explained(told)
    if args.task == "config":
        return told.to_dict() | {"problems": told.problems()}
    from pyspark.sql import SparkSession

    from .models import create_model, load_model, prediction_rows, with_truth
    from .operators.leaderboard import comparison_text, result_comparison
    from .operators.metrics import results, summary
    from .operators.scaling import scaled_dataset
    from .sources import dataset_info, load_dataset
    from .sources.files import data_home

    spark = SparkSession.builder.appName("beaconry").getOrCreate()
    name, options = told.get("dataset.type"), told.to_dict()["dataset"].get("filters", {})
    train, test = load_dataset(spark, name, data_home(args.root), **options)
    if told.get("dataset.normalize", True):
        signal, method = dataset_info(name)["signal"], told.get("dataset.normalize_method", "minmax")
        train, test = (scaled_dataset(d, signal, method) for d in (train, test))
    if args.task == "train":
        model = create_model(told.to_dict()["model"], dataset=train).fit(train)
        if args.model:
            model.save(args.model)
    else:
        model = load_model(spark, args.model)
    both = with_truth(model.predict(test), test)
    if args.out:
        prediction_rows(both).write.mode("overwrite").option("header", True).csv(f"{args.out}/predictions")
        results(both).coalesce(1).write.mode("overwrite").json(f"{args.out}/results")
    figures = results(both).first().asDict()
    print(summary(figures), file=sys.stderr)
    if args.show:
        told = result_comparison(spark, results(both), dataset_info(name)["name"]).collect()
        print(comparison_text(told) if told else "no published results of this dataset", file=sys.stderr)
    return figures


if __name__ == "__main__":
    print(json.dumps(run(parsed(sys.argv[1:])), indent=2, default=str))
