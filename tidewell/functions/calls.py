"""Functions that the engine's users call by names, or with meanings, that Spark does not have.

Each is rewritten into Spark SQL that runs inside the JVM; arguments are SQL texts that have been rewritten already.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Rewrite = Callable[[list[str]], str | None]

#: Other name, same meaning.
RENAMED = {
    "make_array": "array", "make_list": "array", "array_has": "array_contains", "array_element": "try_element_at", "array_extract": "try_element_at",
    "array_to_string": "array_join", "array_concat": "concat", "array_cat": "concat", "array_has_any": "arrays_overlap", "array_reverse": "reverse",
    "array_remove_all": "array_remove", "array_push_back": "array_append", "starts_with": "startswith", "ends_with": "endswith", "strpos": "instr",
    "substr_index": "substring_index", "approx_distinct": "approx_count_distinct", "var": "var_samp", "var_population": "var_pop", "covar": "covar_samp",
    "datetrunc": "date_trunc", "datepart": "date_part", "to_timestamp_seconds": "timestamp_seconds", "to_timestamp_millis": "timestamp_millis",
    "to_timestamp_micros": "timestamp_micros", "today": "current_date", "unnest": "explode", "generate_series": "sequence", "row": "struct",
}

#: Names of types as the engine's users write them.
TYPES = {
    "varchar": "string", "text": "string", "utf8": "string", "largeutf8": "string", "utf8view": "string", "int64": "bigint", "int32": "int", "int16": "smallint", "int8": "tinyint",
    "uint64": "decimal(20,0)", "uint32": "bigint", "uint16": "int", "uint8": "smallint", "float64": "double", "float32": "float", "float16": "float", "real": "float", "bool": "boolean",
    "date32": "date", "bytea": "binary", "timestamp": "timestamp_ntz",
}

_ARROW = {
    "string": "Utf8", "bigint": "Int64", "int": "Int32", "smallint": "Int16", "tinyint": "Int8", "double": "Float64", "float": "Float32",
    "boolean": "Boolean", "date": "Date32", "binary": "Binary", "timestamp_ntz": "Timestamp(Microsecond, None)", "timestamp": "Timestamp(Microsecond, Some(\"+00:00\"))", "void": "Null",
}

#: strftime directives to Java's letters.
_DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE",
    "A": "EEEE", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "%": "%",
}


def unquoted(text: str) -> str | None:
    """The value of a string literal; None for any other text."""
    m = re.fullmatch(r"'((?:[^']|'')*)'", text.strip())
    return m[1].replace("''", "'") if m else None


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def java_pattern(strftime: str) -> str:
    out = []
    for m in re.finditer(r"%(.)|([A-Za-z]+)|(')|([^%A-Za-z']+)", strftime):
        out.append(_DIRECTIVES.get(m[1], m[0]) if m[1] else f"'{m[2]}'" if m[2] else "''" if m[3] else m[4])
    return "".join(out)


def _formatted(args: list[str]) -> str | None:
    pattern = unquoted(args[1]) if len(args) == 2 else None
    return f"date_format({args[0]}, {literal(java_pattern(pattern))})" if pattern is not None and "%" in pattern else None


def _gcd(a: str, b: str) -> str:
    """Euclid's algorithm, which ends within 92 steps for 64-bit numbers."""
    start = f"named_struct('x', abs(CAST({a} AS BIGINT)), 'y', abs(CAST({b} AS BIGINT)))"
    return f"aggregate(sequence(1, 92), {start}, (s, i) -> if(s.y = 0, s, named_struct('x', s.y, 'y', s.x % s.y)), s -> s.x)"


def _trunc(args: list[str]) -> str | None:
    if len(args) == 1:
        return f"CAST(CASE WHEN {args[0]} < 0 THEN ceil({args[0]}) ELSE floor({args[0]}) END AS DOUBLE)"
    if unquoted(args[1]) is not None:
        return None  # of a date
    return f"(signum({args[0]}) * floor(abs({args[0]}) * power(10, {args[1]})) / power(10, {args[1]}))"


def _date_bin(args: list[str]) -> str:
    ts, origin = (f"unix_micros(CAST({x} AS TIMESTAMP))" for x in (args[1], args[2] if len(args) > 2 else "TIMESTAMP_NTZ '1970-01-01 00:00:00'"))
    width = f"unix_micros(TIMESTAMP '1970-01-01 00:00:00Z' + {args[0]})"
    return f"CAST(timestamp_micros({ts} - pmod({ts} - {origin}, {width})) AS TIMESTAMP_NTZ)"


def _pattern(text: str, flags: str) -> str:
    return f"concat('(?{flags})', {text})" if flags else text


def _regexp_replace(args: list[str]) -> str:
    flags = (unquoted(args[3]) or "") if len(args) > 3 else ""
    s, p = args[0], _pattern(args[1], flags.replace("g", ""))
    value = unquoted(args[2])
    r = args[2] if value is None else literal(re.sub(r"\\(\d)", r"$\1", value))
    if "g" in flags:
        return f"regexp_replace({s}, {p}, {r})"
    at, found = f"regexp_instr({s}, {p})", f"regexp_substr({s}, {p})"
    return f"CASE WHEN {at} > 0 THEN concat(left({s}, {at} - 1), regexp_replace({found}, {p}, {r}), substr({s}, {at} + length({found}))) ELSE {s} END"


def _regexp_match(args: list[str]) -> str:
    flags = (unquoted(args[2]) or "") if len(args) > 2 else ""
    p = _pattern(args[1], flags.replace("g", ""))
    groups = len(re.findall(r"(?<!\\)\((?!\?)", unquoted(args[1]) or ""))
    found = ", ".join(f"regexp_extract({args[0]}, {p}, {g})" for g in (range(1, groups + 1) if groups else (0,)))
    return f"CASE WHEN regexp_like({args[0]}, {p}) THEN array({found}) END"


def _hashed(args: list[str]) -> str | None:
    method = (unquoted(args[1]) or "").lower()
    return f"md5({args[0]})" if method == "md5" else f"sha2({args[0]}, {method[3:]})" if method in ("sha224", "sha256", "sha384", "sha512") else None


def _encode(args: list[str]) -> str | None:
    return {"hex": f"lower(hex({args[0]}))", "base64": f"base64({args[0]})"}.get((unquoted(args[1]) or "").lower())


def _decode(args: list[str]) -> str | None:
    return {"hex": f"unhex({args[0]})", "base64": f"unbase64({args[0]})"}.get((unquoted(args[1]) or "").lower())


def _array_cast(args: list[str]) -> str | None:
    kind = unquoted(args[1])
    return f"CAST({args[0]} AS {TYPES.get(kind.lower(), kind)})" if kind else None


def _first_place(a: str, x: str) -> str:
    return f"array_position({a}, {x})"


def _percentile(args: list[str]) -> str:
    return f"percentile_cont({args[0]})" if len(args) == 1 else f"percentile_approx({args[0]}, {args[1]})"


_ARROW_MAP = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in _ARROW.items()) + ")"

#: Names with meanings that need more than another name. None leaves a call as it is.
CALLS: dict[str, Rewrite] = {
    "concat": lambda a: f"concat_ws('', {', '.join(a)})",
    "gcd": lambda a: _gcd(a[0], a[1]),
    "lcm": lambda a: f"if({a[0]} = 0 OR {a[1]} = 0, 0, abs(CAST({a[0]} AS BIGINT) div {_gcd(a[0], a[1])} * {a[1]}))",
    "iszero": lambda a: f"({a[0]} = 0)",
    "trunc": _trunc,
    "log": lambda a: f"log10({a[0]})" if len(a) == 1 else None,
    "to_hex": lambda a: f"lower(hex({a[0]}))",
    "regexp_replace": _regexp_replace,
    "regexp_match": _regexp_match,
    "regexp_like": lambda a: f"regexp_like({a[0]}, {_pattern(a[1], unquoted(a[2]) or '')})" if len(a) == 3 else None,
    "string_to_array": lambda a: rf"split({a[0]}, concat('\\Q', {a[1]}, '\\E'))",
    "date_bin": _date_bin,
    "to_char": _formatted,
    "date_format": _formatted,
    "from_unixtime": lambda a: f"CAST(timestamp_seconds({a[0]}) AS TIMESTAMP_NTZ)" if len(a) == 1 else None,
    "to_unixtime": lambda a: f"unix_seconds(CAST({a[0]} AS TIMESTAMP))",
    "array_length": lambda a: f"CAST(size({a[0]}) AS BIGINT)",
    "array_has_all": lambda a: f"(size(array_except({a[1]}, {a[0]})) = 0)",
    "array_position": lambda a: f"nullif({_first_place(*a)}, 0)",
    "array_positions": lambda a: f"filter(transform(sequence(1, size({a[0]})), i -> if({a[0]}[i - 1] <=> {a[1]}, i, 0)), i -> i > 0)",
    "array_remove": lambda a: f"filter({a[0]}, (v, i) -> i + 1 <> {_first_place(*a)})",
    "array_replace": lambda a: f"transform({a[0]}, (v, i) -> if(i + 1 = {_first_place(a[0], a[1])}, {a[2]}, v))",
    "array_replace_all": lambda a: f"transform({a[0]}, v -> if(v <=> {a[1]}, {a[2]}, v))",
    "array_slice": lambda a: f"slice({a[0]}, {a[1]}, greatest({a[2]} - {a[1]} + 1, 0))",
    "array_sort": lambda a: f"sort_array({a[0]}, {'false' if len(a) > 1 and (unquoted(a[1]) or '').lower() == 'desc' else 'true'})",
    "array_pop_back": lambda a: f"slice({a[0]}, 1, greatest(size({a[0]}) - 1, 0))",
    "array_pop_front": lambda a: f"slice({a[0]}, 2, greatest(size({a[0]}) - 1, 0))",
    "array_empty": lambda a: f"(size({a[0]}) = 0)",
    "array_distance": lambda a: f"sqrt(aggregate(zip_with({a[0]}, {a[1]}, (x, y) -> CAST((x - y) * (x - y) AS DOUBLE)), 0D, (s, v) -> s + v))",
    "range": lambda a: f"if({a[1]} > {a[0]}, sequence({a[0]}, {a[1]} - 1), array())" if len(a) == 2 else None,
    "get_field": lambda a: f"{a[0]}[{a[1]}]",
    "map_extract": lambda a: f"CASE WHEN map_contains_key({a[0]}, {a[1]}) THEN array({a[0]}[{a[1]}]) ELSE array() END",
    "digest": _hashed,
    "sha224": lambda a: f"sha2({a[0]}, 224)", "sha256": lambda a: f"sha2({a[0]}, 256)", "sha384": lambda a: f"sha2({a[0]}, 384)", "sha512": lambda a: f"sha2({a[0]}, 512)",
    "encode": _encode,
    "decode": _decode,
    "arrow_typeof": lambda a: f"coalesce(try_element_at({_ARROW_MAP}, typeof({a[0]})), typeof({a[0]}))",
    "arrow_cast": _array_cast,
    "approx_median": lambda a: f"percentile_approx({a[0]}, 0.5)",
    "approx_percentile_cont": _percentile,
    "approx_percentile_cont_with_weight": lambda a: f"percentile({a[0]}, {a[2]}, CAST({a[1]} AS BIGINT))",
}


def rewritten(name: str, args: list[str]) -> str | None:
    """The call in Spark's SQL, None if it is the same there."""
    low = name.lower()
    if low.startswith("list_"):
        low = "array_" + low[5:]
        if low not in CALLS and low not in RENAMED:
            return f"{low}({', '.join(args)})"
    made = CALLS[low](args) if low in CALLS and args else None
    if made is None and low in RENAMED:
        return f"{RENAMED[low]}({', '.join(args)})"
    return made
