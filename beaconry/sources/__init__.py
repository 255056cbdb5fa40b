"""Readers of sensor datasets: one layout per family, one specification per dataset."""

from .catalog import CATALOG, dataset_info, list_datasets, load_dataset, resolve
from .demo import demo
from .names import NAMES, loader

__all__ = ["CATALOG", "dataset_info", "demo", "list_datasets", "load_dataset", "resolve", *NAMES]


def __getattr__(name: str):
    """The loaders of NAMES, such as ``sources.Tampere``."""
    return loader(name)
