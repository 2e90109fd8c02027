"""The scan engine: an immutable list of guards applied to a text column, in batch and on streams alike."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import spans
from spanloom.operators.guards import Guard, PiiGuard, SecretGuard, TestDataGuard, injection_guard, leakage_guard, scan_all
from spanloom.plans import cascade, risk
from spanloom.plans.policy import GuardPolicy, Policy, guard_settings, resolve_policy
from spanloom.runtime import ship, spread


@dataclass(frozen=True)
class ScanEngine:
    guards: tuple[Guard, ...]
    policy: Policy | None = None

    @property
    def guard_names(self) -> list[str]:
        """Registered guards, disabled ones included."""
        return [g.name for g in self.guards]

    def add_guard(self, guard: Guard) -> ScanEngine:
        return replace(self, guards=(*self.guards, guard))

    def remove_guard(self, name: str) -> ScanEngine:
        return replace(self, guards=tuple(g for g in self.guards if g.name != name))

    def with_config(self, guards: dict[str, dict]) -> ScanEngine:
        """Guards with the given settings over their defaults; guards not named go back to theirs."""
        return replace(self, guards=tuple(replace(g, config=type(g)().config.merged(guards.get(g.name)) if g.name not in ("injection", "leakage") else injection_guard().config.merged(guards.get(g.name))) for g in self.guards))

    def _active(self) -> list[Guard]:
        return [g for g in self.guards if g.config.enabled]

    def detections_of(self, df: DataFrame, text: str = "text") -> DataFrame:
        """A column of detections for each active guard: a null text has none."""
        ship(df.sparkSession)
        scans = {g.name: s for g in self._active() if (s := g.scan()) is not None}
        others = [g for g in self._active() if g.name not in scans]
        x = spread(df)
        if scans:  # one function for all of them
            x = x.withColumn("_scans", scan_all(scans)(F.col(text))).select(*df.columns, *[F.col(f"_scans.{n}").alias(f"_{n}") for n in scans])
        x = x.withColumns({f"_{g.name}": g.detect(F.col(text)) for g in others})
        return x.withColumns({f"_{g.name}": g.finish(F.col(f"_{g.name}")) for g in others})

    def analyze(self, df: DataFrame, text: str = "text", out: str = "results") -> DataFrame:
        """``df`` with an array of guard results in the guards' order."""
        x = self.detections_of(df, text)
        results = F.array(*[g.result(F.col(text), F.col(f"_{g.name}")) for g in self._active()])
        return x.select(*df.columns, results.alias(out))

    def scan(self, df: DataFrame, text: str = "text") -> DataFrame:
        """With ``passed`` (of all guards), ``redacted_last`` (of the last guard that redacts) and ``redacted`` (of all findings together)."""
        x = self.analyze(df, text)
        redactions = F.filter(F.transform(F.col("results"), lambda r: r["redacted_text"]), lambda t: t.isNotNull())
        return x.withColumns({
            "passed": F.forall("results", lambda r: r["passed"]), "redacted_last": F.try_element_at(redactions, F.lit(-1)), "redacted": self.redacted_all(F.col(text), F.col("results")),
        })

    @staticmethod
    def redacted_all(text: Column, results: Column) -> Column:
        """All findings but informational ones replaced at once, whatever the guards' modes."""
        every = F.filter(F.flatten(F.transform(results, lambda r: r["detections"])), lambda d: d["disposition"] != "informational")
        return F.when(F.size(every) > 0, spans.redact(text, every)).otherwise(text)

    def detections(self, df: DataFrame, key: str, text: str = "text", fields: list[str] | None = None) -> DataFrame:
        """Long form: key, then the fields of a detection, all or those wanted; ``ord`` counts within guard and text."""
        x = self.detections_of(df.select(key, text), text)
        every = F.concat(*[F.col(f"_{g.name}") for g in self._active()])
        out = x.select(key, F.inline(every))
        return out if fields is None else out.select(key, *fields)

    def redact(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with its text redacted."""
        x = self.analyze(df, text)
        return x.withColumn(text, self.redacted_all(F.col(text), F.col("results"))).drop("results")

    def redact_selected(self, df: DataFrame, wanted: DataFrame, key: str, text: str = "text") -> DataFrame:
        """Only the spans of ``wanted`` (key, start_pos, end_pos, entity_type), as a reader has chosen them."""
        s = wanted.groupBy(F.col(key).alias("_k")).agg(F.collect_set(F.struct("start_pos", "end_pos", "entity_type")).alias("_s"))
        x = df.join(s, F.col(key) == F.col("_k"), "left")
        return x.withColumn(text, F.when(F.col("_s").isNull(), F.col(text)).otherwise(spans.redact(F.col(text), F.col("_s")))).drop("_k", "_s")

    def policy_scan(self, df: DataFrame, text: str = "text", strip: bool = False) -> DataFrame:
        if self.policy is None:
            raise ValueError("the engine has no policy")
        x = self.scan(df, text)
        return x.withColumn("risk", risk.assess(F.col("results"), self.policy.risk_thresholds, strip))

    def level_tally(self, df: DataFrame, text: str = "text") -> DataFrame:
        """(level, n): how many texts have each level of risk."""
        return self.policy_scan(df.select(text), text).groupBy(F.col("risk.level").alias("level")).agg(F.count("*").alias("n"))

    def redact_fields(self, df: DataFrame, key: str, fields: list[str]) -> DataFrame:
        """Long form (key, field, text, redacted, level) of several text fields of a record, each scanned by itself."""
        long = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("f")).select(key, "f.*")
        return self.policy_scan(long).select(key, "field", "text", "redacted", F.col("risk.level").alias("level"))

    def deep_scan(self, df: DataFrame, key: str, scorer: cascade.Scorer, reviewer: cascade.Reviewer | None = None, text: str = "text") -> DataFrame:
        """The cascade: the guards at their own thresholds, then a model, then a review of what the model is unsure of."""
        plain = replace(self, guards=tuple(type(g)() if g.name not in ("injection", "leakage") else (injection_guard() if g.name == "injection" else leakage_guard()) for g in self.guards))
        x = plain.detections_of(df.select(key, text), text)
        first = x.select(key, text, F.concat(*[F.col(f"_{g.name}") for g in plain._active()]).alias("detections"))
        return cascade.deep_scan(first, key, text, scorer, reviewer)


def create_engine(policy: str | Policy | None = None, overlays: list[str | Policy] = (), config: dict[str, dict] | None = None, entity_types: tuple[str, ...] = (), secret_types: tuple[str, ...] = ()) -> ScanEngine:
    """With a policy: its guards (leakage goes with injection) and invented data unless ignored. Without: the four guards as configured."""
    if policy is None:
        c = config or {}
        guards: list[Guard] = [PiiGuard(entity_types=entity_types), SecretGuard(secret_types=secret_types), injection_guard(), leakage_guard()]
        return ScanEngine(tuple(g.with_config(c.get(g.name)) for g in guards))
    p = resolve_policy(policy, list(overlays))
    settings, stated = guard_settings(p), lambda g: p.guards.get(g, GuardPolicy())
    out: list[Guard] = []
    if stated("pii").enabled is not False:
        out.append(PiiGuard(entity_types=stated("pii").entity_types or ()).with_config(settings.get("pii")))
    if stated("secret").enabled is not False:
        out.append(SecretGuard(secret_types=stated("secret").secret_types or ()).with_config(settings.get("secret")))
    if stated("injection").enabled is not False:
        out += [injection_guard().with_config(settings.get("injection")), leakage_guard().with_config(settings.get("leakage"))]
    if p.test_data_detection != "ignore":
        out.append(TestDataGuard())
    return ScanEngine(tuple(out), p)
