"""Small ONNX models written by hand: the protocol buffer of a graph of a few nodes, without the onnx library."""

from __future__ import annotations

FLOAT, INT64 = 1, 7


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def tensor(name: str, kind: int, dims: list[int | str]) -> bytes:
    shape = b"".join(_field(1, _field(2, d) if isinstance(d, str) else _field(1, d)) for d in dims)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))


def node(operator: str, inputs: list[str], output: str, **integers: int) -> bytes:
    attributes = b"".join(_field(5, _field(1, k) + _field(3, v) + _field(20, 2)) for k, v in integers.items())
    return b"".join(_field(1, i) for i in inputs) + _field(2, output) + _field(4, operator) + attributes


def model(nodes: list[bytes], inputs: list[bytes], output: bytes) -> bytes:
    graph = b"".join(_field(1, n) for n in nodes) + _field(2, "g") + b"".join(_field(11, i) for i in inputs) + _field(12, output)
    return _field(1, 8) + _field(8, _field(1, "") + _field(2, 13)) + _field(7, graph)


def sum_of_two() -> bytes:
    """A model of two integer inputs [n, 1] whose score is their sum."""
    nodes = [node("Add", ["a", "b"], "s"), node("Cast", ["s"], "y", to=FLOAT)]
    return model(nodes, [tensor("a", INT64, ["n", 1]), tensor("b", INT64, ["n", 1])], tensor("y", FLOAT, ["n", 1]))


def identity() -> bytes:
    """A model that gives its sequence [1, length, features] back."""
    return model([node("Identity", ["x"], "y")], [tensor("x", FLOAT, [1, "t", "f"])], tensor("y", FLOAT, [1, "t", "f"]))
