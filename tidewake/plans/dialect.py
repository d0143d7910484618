"""SQL text for two engines from one source: the few spellings that differ."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def micros(self, ts: str) -> str:
        return f"unix_micros(cast({ts} as timestamp))" if self.spark else f"epoch_us({ts})"

    def trunc(self, x: str) -> str:
        """Toward zero, as an int."""
        return f"cast({x} as int)" if self.spark else f"cast(trunc({x}) as int)"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def pmod(self, a: str, b: str) -> str:
        return f"((({a}) % {b}) + {b}) % {b}"

    def percentile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p}e0)" if self.spark else f"quantile_cont({x}, {p})"

    def numbers(self, n: int | str, name: str = "id") -> str:
        return f"(select id as {name} from range({n}))" if self.spark else f"(select range as {name} from range({n}))"

    def fmt(self, pattern: str, *args: str) -> str:
        return f"{'format_string' if self.spark else 'printf'}('{pattern}', {', '.join(args)})"

    def utc_text(self, epoch: str) -> str:
        """yyyy-mm-dd hh:mm:ss of epoch seconds."""
        if self.spark:
            return f"date_format(timestamp_seconds({epoch}), 'yyyy-MM-dd HH:mm:ss')"
        return f"strftime(make_timestamp(cast(floor(({epoch}) * 1e6) as bigint)), '%Y-%m-%d %H:%M:%S')"

    def parse_utc(self, text: str) -> str:
        """Epoch seconds of yyyymmddThhmmss."""
        if self.spark:
            return f"cast(unix_micros(to_timestamp({text}, \"yyyyMMdd'T'HHmmss\")) / 1e6 as double)"
        return f"cast(epoch_us(strptime({text}, '%Y%m%dT%H%M%S')) / 1e6 as double)"

    def unnest(self, alias: str, array: str) -> str:
        """A lateral join that gives a row an element."""
        return f"lateral view explode({array}) x_{alias} as {alias}" if self.spark else f"cross join lateral (select unnest({array}) as {alias}) x_{alias}"

    def sequence(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})" if self.spark else f"range({a}, ({b}) + 1)"

    def joined(self, x: str, order: str, sep: str) -> str:
        """Strings of a group in order, as one."""
        if self.spark:
            return f"array_join(transform(array_sort(collect_list(struct({order} as o, {x} as v))), e -> e.v), '{sep}')"
        return f"string_agg({x}, '{sep}' order by {order})"

    def recursion(self, name: str, columns: str, first: str, step: str, depth: int) -> str:
        limit = f"max recursion level {depth}" if self.spark else ""
        return f"with recursive {name}({columns}) {limit} as ({first} union all {step})"


SPARK, DUCKDB = Dialect(True), Dialect(False)


def quick_round(x: str, digits: int) -> str:
    """Spark's ``round`` of a double, in whole numbers where no tie is near: its decimals cost more than the rest of a row."""
    y = f"({x}) * {10**digits}e0"
    return f"case when abs({y}) < 1e9 and abs({y} - floor({y}) - 0.5e0) > 1e-6 then floor({y} + 0.5e0) / {10**digits}e0 else round({x}, {digits}) end"


def told(pattern: str, *args: str) -> str:
    """What Spark's ``format_string`` gives, joined from parts: numbers must come as ``round(x, n)`` for ``%.0f`` and ``%.1f``."""
    parts, left = [], list(args)
    for piece in re.findall(r"%%|%s|%d|%\.[012]f|[^%]+", pattern):
        if piece[0] != "%" or piece == "%%":
            parts.append(f"'{piece.replace('%%', '%')}'")
            continue
        arg = left.pop(0)
        if piece in ("%s", "%d"):
            parts.append(f"cast({arg} as string)")
        elif piece == "%.2f":
            parts.append(f"cast(cast({arg} as decimal(9,2)) as string)")
        else:
            x, n = re.fullmatch(r"round\((.*), ([01])\)", arg).groups()
            assert piece == f"%.{n}f"
            number = quick_round(x, int(n)) if n == "1" else f"cast({quick_round(x, 0)} as bigint)"
            parts.append(f"case when abs({x}) < 1e6 then cast({number} as string) else format_string('{piece}', {arg}) end")
    return f"concat({', '.join(parts)})"


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Kilometres on a sphere of 6371 km; null where a place is."""
    a = f"power(sin(radians({lat2} - {lat1}) / 2e0), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2e0), 2)"
    # Least passes over nulls, so its limit is null where the sum is.
    one = f"1e0 + 0e0 * ({lon1} + {lat1} + {lon2} + {lat2})"
    return f"(2e0 * 6371e0 * asin(sqrt(least({a}, {one}))))"


def bearing(d: Dialect, lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Compass course in degrees, 0 to 360."""
    y = f"sin(radians({lon2} - {lon1})) * cos(radians({lat2}))"
    x = f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1}))"
    return f"({d.pmod(f'degrees(atan2({y}, {x}))', '360e0')})"
