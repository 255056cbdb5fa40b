"""MAT files written by the public format and read back: arrays, structs, compression, byte orders."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pytest

from beaconry.sources import load_dataset, mat

KINDS = {"f8": (9, 6), "f4": (7, 7), "i1": (1, 8), "u1": (2, 9), "i2": (3, 10), "u2": (4, 11), "i4": (5, 12), "u4": (6, 13)}


def element(kind, data, order="<"):
    if 0 < len(data) <= 4:
        return struct.pack(f"{order}I", len(data) << 16 | kind) + data.ljust(4, b"\0")
    return struct.pack(f"{order}II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def head_of(name, cls, shape, order, flags=0):
    return element(6, struct.pack(f"{order}II", cls | flags << 8, 0), order) + element(5, struct.pack(f"{order}{len(shape)}i", *shape), order) + element(1, name.encode(), order)


def array(name, a, order="<"):
    a = np.asarray(a)
    real = a.real if a.dtype.kind == "c" else a
    kind, cls = KINDS[real.dtype.str[1:]]
    shape = a.shape if a.ndim > 1 else (1, a.size)
    body = head_of(name, cls, shape, order, 8 if a.dtype.kind == "c" else 0)
    for part in (a.real, a.imag) if a.dtype.kind == "c" else (a,):
        body += element(kind, part.astype(order + real.dtype.str[1:]).tobytes(order="F"), order)
    return element(14, body, order)


def record(name, entries, order="<"):
    fields = list(entries[0])
    body = head_of(name, 2, (1, len(entries)), order) + element(5, struct.pack(f"{order}i", 16), order) + element(1, b"".join(f.encode().ljust(16, b"\0") for f in fields), order)
    return element(14, body + b"".join(array("", e[f], order) for e in entries for f in fields), order)


def squeezed_in(e, order="<"):
    z = zlib.compress(e)
    return struct.pack(f"{order}II", 15, len(z)) + z


def file(*elements, order="<"):
    return b"test".ljust(124) + struct.pack(f"{order}H", 0x0100) + (b"IM" if order == "<" else b"MI") + b"".join(elements)


def read(content):
    """Arrays by name, entry, field, put together from their slices."""
    out = {}
    for name, index, field, shape, part, at, values in mat.slices(io.BytesIO(content)):
        flat = out.setdefault((name, index, field), np.zeros(int(np.prod(shape)), complex))
        flat[at : at + len(values)] += values * (1j if part == "im" else 1)
        out[name, index, field, "shape"] = tuple(shape)
    return {k: v.reshape(out[(*k, "shape")], order="F") for k, v in out.items() if len(k) == 3}


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packed", [False, True])
def test_round_trip(monkeypatch, order, packed):
    monkeypatch.setattr(mat, "CHUNK", 7)
    monkeypatch.setattr(mat, "INFLATED", 5)
    r = np.random.default_rng(1)
    told = {"a": r.normal(0, 1, (4, 5, 3)), "b": r.integers(-9, 9, (3, 2)).astype("i2"), "tiny": np.array([[7]], "u1"), "c": r.normal(0, 1, (2, 9)) + 1j * r.normal(0, 1, (2, 9)), "none": np.zeros((0, 3))}
    text = element(14, head_of("words", 4, (1, 5), order) + element(4, "hello".encode("utf-16-le"), order), order)
    user = [{"channel": r.normal(0, 1, (2, 3)) + 0j, "loc": r.normal(0, 1, 3)} for _ in range(4)]
    parts = [array(k, v, order) for k, v in told.items()]
    parts[1:1] = [text, record("user", user, order)]
    got = read(file(*(squeezed_in(p, order) if packed else p for p in parts), order=order))
    for k, v in told.items():
        if v.size:
            assert np.allclose(got[k, 0, ""], v), k
    for n, u in enumerate(user):
        assert np.allclose(got["user", n, "channel"], u["channel"]) and np.allclose(got["user", n, "loc"].ravel(), u["loc"])
    assert not any(k[0] == "words" for k in got)
    with pytest.raises(ValueError, match="level 5"):
        read(b"x" * 200)
    with pytest.raises(ValueError, match="ends"):
        read(file(parts[0])[:-9])


def test_slices_are_bounded(monkeypatch):
    monkeypatch.setattr(mat, "CHUNK", 100)
    sizes = [len(v) for *_, v in mat.slices(io.BytesIO(file(squeezed_in(array("a", np.ones((50, 41)))))))]
    assert max(sizes) == 100 and sum(sizes) == 2050


def test_scenarios(spark, tmp_path):
    r = np.random.default_rng(2)
    h, at = r.normal(0, 1, (6, 2, 3)) + 1j * r.normal(0, 1, (6, 2, 3)), r.normal(0, 1, (6, 3))
    users = [{"channel": r.normal(0, 1, (2, 3)) + 1j * r.normal(0, 1, (2, 3)), "loc": r.normal(0, 1, 2)} for _ in range(5)]
    (tmp_path / "plain.mat").write_bytes(file(squeezed_in(array("channels", h)), array("user_loc", at)))
    (tmp_path / "struct.mat").write_bytes(file(array("H", h), record("user", users)))
    (tmp_path / "placeless.mat").write_bytes(file(array("csi", h[:, 0, 0].real)))
    rows = load_dataset(spark, "deepmimo", str(tmp_path), "all").collect()
    by = {}
    for x in rows:
        by.setdefault(x["scenario"], []).append(x)
    found = {tuple(round(v, 9) for v in (x["x"], x["y"], x["z"])): [complex(c["re"], c["im"]) for c in x["features"]] for x in by["plain"]}
    assert len(by["plain"]) == 6 and all(np.allclose(found[tuple(round(v, 9) for v in p)], h[k].ravel()) for k, p in enumerate(at.tolist()))
    found = {(round(x["x"], 9), round(x["y"], 9), x["z"]): [complex(c["re"], c["im"]) for c in x["features"]] for x in by["struct"]}
    assert len(by["struct"]) == 5 and all(np.allclose(found[round(u["loc"][0], 9), round(u["loc"][1], 9), 0.0], u["channel"].ravel()) for u in users)
    assert [(x["x"], len(x["features"])) for x in by["placeless"]] == [(0.0, 6)]
    one = load_dataset(spark, "deepmimo", str(tmp_path), "all", scenario="plain")
    assert one.count() == 6
