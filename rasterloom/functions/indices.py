"""Spectral and radar indices: a catalogue of formulas, evaluated as SQL expressions over band columns."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalogue import CONSTANTS, FORMULAS

#: Which band columns stand for which parameter, by number and by common name.
BAND_NAMES = {
    "B": r"^b0?2($|_)|_b0?2$|blue", "G": r"^b0?3($|_)|_b0?3$|green", "R": r"^b0?4($|_)|_b0?4$|^red$", "RE1": r"^b0?5($|_)|_b0?5$|rededge1|^re1", "RE2": r"^b0?6($|_)|_b0?6$|rededge2|^re2", "RE3": r"^b0?7($|_)|_b0?7$|rededge3|^re3",
    "N": r"^b0?8a?($|_)|_b0?8$|nir", "S1": r"^b11($|_)|_b11$|swir_?1", "S2": r"^b12($|_)|_b12$|swir_?2",
}
POSITIONS = tuple(BAND_NAMES)


def parameters(columns: list[str]) -> dict[str, str]:
    """Parameter to column, by name where one column alone fits it. If none is blue and there are nine columns or more, all by position."""
    fits = {p: [c for c in columns if re.search(rx, c, re.I)] for p, rx in BAND_NAMES.items()}
    by_name = {p: c[0] for p, c in fits.items() if len(c) == 1}
    return dict(zip(POSITIONS, columns)) if "B" not in by_name and len(columns) >= len(POSITIONS) else by_name


def names(formula: str) -> set[str]:
    return {n.id for n in ast.walk(ast.parse(formula, mode="eval")) if isinstance(n, ast.Name)}


def usable_formulas(have: dict[str, str], formulas: dict[str, str] = FORMULAS) -> dict[str, str]:
    """The formulas that use a band, and all of whose names are known. A formula that can't be read is kept, and fails where it is evaluated."""

    def usable(f: str) -> bool:
        try:
            n = names(f)
        except SyntaxError:
            return True
        return bool(n & set(have)) and n <= set(have) | set(CONSTANTS)

    return {k: f for k, f in formulas.items() if usable(f)}


def as_column(formula: str, values: dict[str, Column]) -> Column:
    """A formula of names, numbers, + - * / ** as a column. Division by zero gives null."""
    ops = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Pow: F.pow}

    def walk(n: ast.expr) -> Column:
        if isinstance(n, ast.BinOp):
            return ops[type(n.op)](walk(n.left), walk(n.right))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -walk(n.operand)
        return values[n.id] if isinstance(n, ast.Name) else F.lit(float(n.value))

    return walk(ast.parse(formula, mode="eval").body)


def evaluate(df: DataFrame, have: dict[str, str], formulas: dict[str, str] = FORMULAS, scale: float = 1.0) -> DataFrame:
    """Adds the indices, all of the catalogue that the bands suffice for: divisions by zero and values that aren't finite are null."""
    values = {k: F.lit(v) for k, v in CONSTANTS.items()} | {p: F.col(f"`{c}`") / scale for p, c in have.items()}
    cols = {k: as_column(f, values) for k, f in usable_formulas(have, formulas).items()}
    return df.withColumns({k: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) for k, c in cols.items()})


def probe(df: DataFrame, formulas: dict[str, str], have: dict[str, str]) -> dict[str, str]:
    """'ok', 'skipped' (names unknown) or 'error' for each formula, found by analysing it, without reading rows."""
    ok = usable_formulas(have, formulas)

    def status(some: dict[str, str]) -> str:
        try:
            _ = evaluate(df.limit(0), have, some).schema
            return "ok"
        except Exception:  # noqa: BLE001  whatever analysis says is the result
            return "error"

    whole = status(ok)
    return {k: "skipped" if k not in ok else whole if whole == "ok" else status({k: f}) for k, f in formulas.items()}


def to_linear(c: Column) -> Column:
    return F.pow(F.lit(10.0), c / 10)


def to_db(c: Column) -> Column:
    return 10 * F.log10(F.greatest(c, F.lit(1e-10)))


def radar_indices(hh: Column, hv: Column) -> dict[str, Column]:
    """From linear backscatter. The published names and formulas."""
    s = hh + hv
    return {
        "RVI": F.try_divide(4 * hv, s), "RFDI": F.try_divide(hh - hv, s), "HH_HV_Ratio": F.try_divide(hv, hh), "HH_HV_Sum": s, "HH_HV_Diff": hh - hv, "HH_HV_Mean": s / 2, "NDI": F.try_divide(hh - hv, s),
        "HV_dB": to_db(hv), "HH_dB": to_db(hh), "Ratio_dB": to_db(hv / F.greatest(hh, F.lit(1e-10))), "BMI": s / 2, "VSI": F.try_divide(hv, s) * 100, "Span": hh + 2 * hv, "PDI": F.sqrt(hh * hh + hv * hv),
    }


def linear_if_db(df: DataFrame, cols: list[str], nodata: float | None = None) -> DataFrame:
    """Masks nodata, then turns bands whose mean is negative from decibels to linear."""
    clean = df.withColumns({c: F.when(F.col(c) == nodata, None).otherwise(F.col(c)) for c in cols}) if nodata is not None else df
    means = clean.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    out = clean.crossJoin(F.broadcast(means))
    return out.select(*[c for c in df.columns if c not in cols], *[F.when(F.col(f"_m_{c}") < 0, to_linear(F.col(c))).otherwise(F.col(c)).alias(c) for c in cols])
