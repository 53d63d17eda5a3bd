"""Numbers of level 5 MAT-files (the public format): numeric arrays, and structs of them."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Element types of the format, and names under which capacities are found.
_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_MATRIX, _COMPRESSED, _STRUCT, _CELL, _CHAR = 14, 15, 2, 1, 4
CAPACITY = ("capacity", "Capacity")


def _element(data: bytes, at: int) -> tuple[int, bytes, int]:
    """(type, content, position behind it)"""
    kind, size = struct.unpack_from("<II", data, at)
    if kind >> 16:  # small elements keep their content in the tag
        return kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)], at + 8
    end = at + 8 + size
    return kind, data[at + 8 : end], end if kind == _COMPRESSED else end + -size % 8


def _values(kind: int, content: bytes) -> np.ndarray:
    return np.frombuffer(content, "<" + _TYPES[kind])


def _matrix(data: bytes):
    _, flags, at = _element(data, 0)
    kind = flags[0]
    t, dims, at = _element(data, at)
    shape = tuple(_values(t, dims).tolist())
    _, name, at = _element(data, at)
    if kind == _STRUCT:
        t, width, at = _element(data, at)
        width = int(_values(t, width)[0])
        _, names, at = _element(data, at)
        fields = [names[k : k + width].split(b"\0")[0].decode() for k in range(0, len(names), width)]
        out = []
        for _ in range(int(np.prod(shape))):
            one = {}
            for f in fields:
                _, content, at = _element(data, at)
                one[f] = _matrix(content)[1] if content else np.zeros(0)
            out.append(one)
        return name.decode(), out[0] if len(out) == 1 else out
    if kind == _CELL:
        out = []
        for _ in range(int(np.prod(shape))):
            _, content, at = _element(data, at)
            out.append(_matrix(content)[1] if content else np.zeros(0))
        return name.decode(), out
    t, content, at = _element(data, at)
    v = _values(t, content) if t in _TYPES else np.zeros(0)
    return name.decode(), "".join(map(chr, v)) if kind == _CHAR else v.reshape(shape, order="F") if v.size == int(np.prod(shape)) else v


def variables(data: bytes) -> dict:
    out, at = {}, 128
    while at + 8 <= len(data):
        kind, content, at = _element(data, at)
        if kind == _COMPRESSED:
            kind, content, _ = _element(zlib.decompress(content), 0)
        if kind == _MATRIX:
            name, value = _matrix(content)
            out[name] = value
    return out


def _series(value) -> np.ndarray:
    v = np.asarray(value, float)
    return v[:, 0] if v.ndim == 2 and min(v.shape) > 1 else v.ravel()


def capacities(data: bytes) -> dict[str, np.ndarray]:
    """The capacity series of each cell: a field of that name, else the first numeric field of more than 10 values; vectors as they are."""
    out = {}
    for name, value in variables(data).items():
        if isinstance(value, dict):
            numeric = {k: _series(v) for k, v in value.items() if isinstance(v, np.ndarray) and v.dtype.kind in "fiu"}
            chosen = next((numeric[k] for k in CAPACITY if k in numeric), next((v for v in numeric.values() if len(v) > 10), None))
            if chosen is not None:
                out[name] = chosen
        elif isinstance(value, np.ndarray) and value.dtype.kind in "fiu":
            out[name] = _series(value)
    return out
