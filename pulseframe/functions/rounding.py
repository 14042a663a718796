"""Rounding on the exact binary value of a double."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseframe.functions.binding import let


def round_exact(x: Column, digits: int) -> Column:
    """Nearest multiple of ``10^-digits``, true ties to even.

    ``round`` works on the shortest decimal form instead, so 0.35 would become 0.4; here the
    rounding error of ``x * 10^digits`` decides such cases.
    """
    scale = float(10**digits)

    def halves(x: Column) -> Column:
        c = x * 134217729.0  # splits x into two halves whose products are exact
        return F.struct(x.alias("x"), (x * scale).alias("p"), (c - (c - x)).alias("high"))

    def excess(s: Column) -> Column:
        n = F.floor(s["p"]).cast("double")
        err = (s["high"] * scale - s["p"]) + (s["x"] - s["high"]) * scale
        return F.struct(n.alias("n"), ((s["p"] - n - 0.5) + err).alias("past"))

    def nearest(e: Column) -> Column:
        up = (e["past"] > 0) | ((e["past"] == 0) & (e["n"] % 2 != 0))
        return (e["n"] + F.when(up, 1.0).otherwise(0.0)) / scale

    return let(x.cast("double"), lambda v: let(halves(v), lambda s: let(excess(s), nearest)))


def fixed_text(x: Column, digits: int) -> Column:
    """``x`` printed with a fixed number of decimals."""

    def show(pair: Column) -> Column:
        sign = F.when((pair["x"] < 0) & (pair["r"] == 0), "-").otherwise("")
        return F.concat(sign, F.format_string(f"%.{digits}f", pair["r"]))

    return let(x.cast("double"), lambda v: let(F.struct(v.alias("x"), round_exact(v, digits).alias("r")), show))


def message(template: str, *values: Column) -> Column:
    """Fill a printf-style template."""
    specs = re.findall(r"%(?:\.\d+)?[df]", template.replace("%%", ""))
    texts = [fixed_text(v, int(s[2:-1])) if s.endswith("f") else v for s, v in zip(specs, values)]
    return F.format_string(re.sub(r"%\.\d+f", "%s", template), *texts)
