"""The chain of compaction: a registry of stages by priority, routing, verification and fallback."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, token_estimate
from . import classify, dedup, jsonops, textops, verify
from .entropy import char_entropy_of


@dataclass(frozen=True)
class Preset:
    """Settings of a run. ``off`` names stages that don't run."""

    name: str = "default"
    max_run: int = 3
    fold_least: int = 3
    fold_over: int = 200
    abbreviate: bool = False
    json: bool = True
    max_string: int = 500
    max_items: int = 10
    ref_dedup: bool = True
    off: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("preset: a name is needed")
        if self.max_run < 1 or self.fold_least < 2:
            raise ValueError("preset: max_run must be at least 1 and fold_least at least 2")
        if self.max_string < 1 or self.max_items < 1:
            raise ValueError("preset: max_string and max_items must be at least 1")

    @classmethod
    def parse(cls, text: str) -> Preset:
        data = tomllib.loads(text)
        unknown = set(data) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"preset: unknown settings {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})

    def dump(self) -> str:
        show = lambda v: str(v).lower() if isinstance(v, bool) else repr(list(v)) if isinstance(v, tuple) else f'"{v}"' if isinstance(v, str) else str(v)
        return "".join(f"{k} = {show(v)}\n" for k, v in asdict(self).items()).replace("'", '"')


@dataclass(frozen=True)
class Stage:
    """One rewriting of a text column. Stages run in the order of their priority."""

    name: str
    priority: int
    apply: Callable[[Column, Preset], Column]


STAGES: list[Stage] = [
    Stage("ansi_strip", 0, lambda t, p: textops.ansi_strip(t)),
    Stage("abbreviate", 25, lambda t, p: textops.abbreviate(t) if p.abbreviate else t),
    Stage("condense", 30, lambda t, p: dedup.condense(t, p.max_run)),
    Stage("fold_runs", 90, lambda t, p: F.when(F.octet_length(t) > p.fold_over, dedup.fold_runs(t, p.fold_least)).otherwise(t)),
]


def register(stage: Stage) -> None:
    """Add a stage of one's own; a stage of the same name is replaced."""
    STAGES[:] = sorted([s for s in STAGES if s.name != stage.name] + [stage], key=lambda s: (s.priority, s.name))


def chain(df: DataFrame, text: str, preset: Preset, out: str = "compacted") -> DataFrame:
    """All stages in turn; ``stages`` lists those that changed the text. One nested expression, so each stage runs once a row."""
    state = F.struct(F.col(text).alias("t"), F.array().cast("array<string>").alias("done"))

    def after(state: Column, stage: Stage) -> Column:
        def run(held: Column) -> Column:
            return let(stage.apply(held["t"], preset), lambda new: F.struct(new.alias("t"), F.when(new != held["t"], F.concat(held["done"], F.array(F.lit(stage.name)))).otherwise(held["done"]).alias("done")))

        return let(state, run)

    for s in sorted(STAGES, key=lambda s: s.priority):
        if s.name not in preset.off:
            state = after(state, s)
    return df.withColumn("__state", state).select("*", F.col("__state.t").alias(out), F.col("__state.done").alias("stages")).drop("__state")


def json_form(text: Column, preset: Preset) -> Column:
    """A JSON text without noise, nulls and long strings and arrays, in the compact notation, where that has fewer bytes; other
    texts as they are. It is parsed once."""
    steps = (jsonops.project, jsonops.strip_nulls, lambda v: jsonops.truncate_strings(v, preset.max_string), lambda v: jsonops.collapse_arrays(v, preset.max_items))
    return jsonops.shorter(text, *steps, out=jsonops.encode)


def compact(df: DataFrame, key: str, text: str, preset: Preset = Preset()) -> DataFrame:
    """Compacts each distinct text once and joins it back to its copies, which become references. A null text counts as empty.

    JSON goes through ``json_form`` in place of the stages for lines. Risky texts pass unchanged but for escapes; where the checks
    give too little confidence the original stays.
    """
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.sha2("text", 256))
    first = rows.groupBy("hash").agg(F.min(key).alias("__first"))
    one = rows.join(first.select(F.col("__first").alias(key)), key, "left_semi")
    one = one.withColumn("entropy", F.coalesce(char_entropy_of("text"), F.lit(0.0))).withColumn("mode", classify.route(F.col("text"), F.col("entropy")))
    one = chain(one, "text", preset)
    if preset.json:
        # A text that no bracket opens never reaches a Python worker's parser.
        opened = F.substring(F.ltrim("text"), 1, 1).isin("{", "[")
        one = one.withColumn("__json", json_form(F.when(opened, F.col("text")), preset))
        written = F.col("__json").startswith("TOON:") & ~F.col("text").startswith("TOON:")
        one = one.withColumn("compacted", F.when(written, F.col("__json")).otherwise(F.col("compacted"))).withColumn("stages", F.when(written, F.array(F.lit("json"))).otherwise(F.col("stages"))).drop("__json")
    passed = [f(F.col("text"), F.col("compacted")).alias(n) for n, f in verify.CHECKS.items()]
    one = one.select("*", *passed, verify.preservation(F.col("text"), F.col("compacted")).alias("preservation"))
    one = one.withColumn("confidence", verify.confidence([F.col(n) for n in verify.CHECKS], F.col("preservation")))
    back = (F.col("confidence") < verify.FALLBACK) | (F.col("mode") == "safe")
    one = one.withColumn("out", F.when(back, textops.ansi_strip(F.col("text"))).otherwise(F.col("compacted")))
    one = one.select("hash", "mode", "confidence", "stages", "out", token_estimate(F.col("out")).alias("__tokens"))
    x = dedup.join_hot(rows, first.join(one, "hash"))
    copy = (F.col(key) != F.col("__first")) & F.lit(preset.ref_dedup)
    return x.select(key, "mode", "confidence", "stages", F.when(copy, F.concat(F.lit("§ref:"), F.substring("hash", 1, 16), F.lit("§"))).otherwise(F.col("out")).alias("compacted"), token_estimate(F.col("text")).alias("tokens_original"), F.when(copy, F.lit(dedup.REFERENCE_TOKENS).cast("long")).otherwise(F.col("__tokens")).alias("tokens_compacted"))
