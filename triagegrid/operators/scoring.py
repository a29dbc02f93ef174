"""Decisions against labelled tickets.

The scorer makes one row per ticket; every figure is an aggregate of those rows and every list is a
filtered set of rows, so nothing grows inside a single task.  Ambiguity is read differently by
metric: a missed escalation ignores it, a false one respects it, and an urgency is tolerated only
when it is marked and no more than one level off.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagegrid import lexicon as L
from triagegrid.functions.labels import answer_label, two_places
from triagegrid.functions.ordinal import urgency_rank
from triagegrid.functions.text import contains_all


def join_gold(gold: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pair each labelled row with its decision (external_id = id)."""
    d = decisions.select(F.struct("*").alias("decision"), F.col("ticket.external_id").alias("id"))
    return gold.join(d, "id")


def coverage_gaps(gold: DataFrame, decisions: DataFrame) -> DataFrame:
    """Labelled ids without a decision; a run with any is not comparable."""
    return gold.select("id").join(decisions.select(F.col("ticket.external_id").alias("id")), "id", "left_anti")


def require_coverage(gold: DataFrame, decisions: DataFrame) -> None:
    gap = coverage_gaps(gold, decisions).take(1)
    if gap:
        raise ValueError(f"the run does not cover every labelled ticket, for example {gap[0]['id']!r}")


def must_escalate(gold: DataFrame) -> DataFrame:
    return gold.where(F.col("expected.escalate"))


def only_ids(df: DataFrame, ids: DataFrame | Sequence[str] | None = None, prefix: str | None = None, column: str = "id") -> DataFrame:
    """The rows whose id is listed, or starts with a prefix, or both.

    A short list becomes part of the plan; a table of ids (its first column) of any length is met by a semi-join.
    """
    if isinstance(ids, DataFrame):
        df = df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi").select(*df.columns)
    elif ids is not None:
        df = df.where(F.col(column).isin(list(ids)))
    return df.where(F.col(column).startswith(prefix)) if prefix is not None else df


def require_count(df: DataFrame, expected: int, what: str = "rows") -> DataFrame:
    """``df`` itself, or an error if it does not hold exactly ``expected`` rows: a selection that lost some must not pass unseen."""
    found = df.count()
    if found != expected:
        raise ValueError(f"expected {expected} {what}, found {found}")
    return df


def score(gold: DataFrame, decisions: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    return score_pairs(join_gold(gold, decisions), also)


def score_pairs(pairs: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """One scored row per (labelled row, ``decision`` struct); ``also`` names columns of the decision to keep, as ``run`` of ``decide_runs``."""
    e, d = F.col("expected"), F.col("decision")
    x, who = d["extraction"], d["extraction"]["customer"]
    amb = F.coalesce(F.col("ambiguous"), F.array().cast("array<string>"))
    free = {name: F.array_contains(amb, name) for name in ("category", "urgency", "escalate")}
    apart = F.abs(urgency_rank(x["urgency"]) - urgency_rank(e["urgency"]))
    same_urgency = x["urgency"] == e["urgency"]
    want, got = F.coalesce(e["customer_name"], F.lit("")), F.coalesce(who["name"], F.lit(""))
    no_name = e["customer_name"].isNull() & who["name"].isNull()
    band = e["customer_confidence"]
    want_id = F.coalesce(e["identifier_contains"], F.lit(""))
    ids = F.coalesce(F.array_join(who["identifiers"], "\x00"), F.lit(""))
    return pairs.select(
        "id",
        "group",
        e["escalate"].alias("must_escalate"),
        x["escalate"].alias("escalated"),
        ((x["escalate"] == e["escalate"]) | free["escalate"]).alias("escalation_ok"),
        (e["escalate"] & ~x["escalate"]).alias("missed_escalation"),
        (~e["escalate"] & x["escalate"] & ~free["escalate"]).alias("false_escalation"),
        F.coalesce(contains_all(x["escalation_reasons"], e["reasons"]), F.lit(True)).alias("reasons_ok"),
        ((x["category"] == e["category"]) | free["category"]).alias("category_ok"),
        same_urgency.alias("urgency_exact"),
        (same_urgency | (free["urgency"] & (apart <= 1))).alias("urgency_ok"),
        (no_name | ((want != "") & (got != "") & F.contains(F.lower(got), F.lower(want)))).alias("customer_ok"),
        band.isNotNull().alias("confidence_scored"),
        F.coalesce(who["confidence"] <= F.get(band, F.lit(1)), F.lit(True)).alias("confidence_ceiling_ok"),
        # The floor is a quality bar for model reads; keywords may honestly report nothing.
        F.coalesce(
            (d["mode"] != L.MODE_MODEL) | (who["confidence"] >= F.get(band, F.lit(0))), F.lit(True)
        ).alias("confidence_floor_ok"),
        who["confidence"].alias("confidence_got"),
        band.alias("confidence_band"),
        who["best_guess"].alias("guess"),
        ((F.size(who["basis"]) > 0) | (who["confidence"] == 0.0)).alias("basis_given"),
        ((want_id == "") | F.contains(ids, want_id)).alias("identifier_ok"),
        F.sort_array(amb).alias("ambiguous"),
        d["queue"].alias("queue"),
        F.struct(
            x["category"].alias("category"),
            x["urgency"].alias("urgency"),
            x["escalate"].alias("escalate"),
            x["escalation_reasons"].alias("reasons"),
            who["name"].alias("customer"),
        ).alias("got"),
        e.alias("expected"),
        *[d[c].alias(c) for c in also],
    )


def _share(condition: Column, among: Column | None = None) -> Column:
    return F.avg(F.when(among, condition.cast("int")) if among is not None else condition.cast("int"))


def _gap() -> Column:
    return urgency_rank(F.col("got.urgency")) - urgency_rank(F.col("expected.urgency"))


def _direction_figures() -> list[Column]:
    gap = _gap()
    clear = ~F.array_contains("ambiguous", "urgency")
    under_critical = (F.col("expected.urgency") == "critical") & (F.col("got.urgency") != "critical")
    return [
        F.count_if(gap < 0).alias("urgency_under"),
        F.count_if(gap > 0).alias("urgency_over"),
        _share(gap < 0).alias("urgency_under_rate"),
        _share(gap > 0).alias("urgency_over_rate"),
        F.count_if((gap < 0) & clear).alias("urgency_hard_under"),
        (F.count_if(under_critical) == 0).alias("urgency_never_under_critical"),
    ]


def urgency_direction(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Under- and over-calls are different failures: counts and rates by direction."""
    return scores.groupBy(*by).agg(*_direction_figures())


def _calibration_figures() -> list[Column]:
    banded = F.col("confidence_scored")
    inside = F.col("confidence_floor_ok") & F.col("confidence_ceiling_ok")
    return [
        F.count_if(banded).alias("confidence_banded"),
        (F.count_if(banded & inside) / F.greatest(F.count_if(banded), F.lit(1))).alias("confidence_calibration"),
        F.count_if(banded & ~F.col("confidence_ceiling_ok")).alias("overconfidence"),
        F.count_if(banded & ~inside).alias("confidence_misses"),
    ]


def calibration(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scores.groupBy(*by).agg(*_calibration_figures())


def scorecard(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every headline figure in one pass.  Recall is 1 when nothing had to escalate."""
    must = F.col("must_escalate")
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(must).alias("must_n"),
        F.coalesce(_share(F.col("escalated"), must), F.lit(1.0)).alias("escalation_recall"),
        F.count_if("missed_escalation").alias("missed_escalations"),
        F.count_if("false_escalation").alias("false_escalations"),
        F.coalesce(_share(F.col("reasons_ok"), must), F.lit(1.0)).alias("reasons_accuracy"),
        _share(F.col("category_ok")).alias("category_accuracy"),
        _share(F.col("got.category") == F.col("expected.category")).alias("category_strict"),
        _share(F.col("urgency_exact")).alias("urgency_exact"),
        _share(F.col("urgency_ok")).alias("urgency_accuracy"),
        _share(F.col("customer_ok")).alias("customer_accuracy"),
        _share(F.col("identifier_ok")).alias("identifier_accuracy"),
        *_calibration_figures(),
        F.bool_and("basis_given").alias("basis_always_given"),
        *_direction_figures(),
    )


OFFENCES = [
    "missed_escalations", "false_escalations", "urgency_under", "urgency_over", "urgency_hard_under", "overconfidence",
    "confidence_misses",
]


def offenders(scores: DataFrame, kind: str | None = None) -> DataFrame:
    """The rows behind the figures: kind, id, entry.  A ticket appears once per kind it offends in."""
    gap = _gap()
    told = F.concat_ws("", "id", F.lit(" said "), "got.urgency", F.lit(", gold "), "expected.urgency")
    band = F.col("confidence_band")
    got = two_places(F.col("confidence_got"))
    over = F.concat(F.col("id"), F.lit(" claimed "), got, F.lit(", ceiling "), F.get(band, F.lit(1)).cast("string"))
    miss = F.concat(F.col("id"), F.lit(" got "), got, F.lit(", expected ["), F.array_join(band.cast("array<string>"), ", "), F.lit("]"))
    inside = F.col("confidence_floor_ok") & F.col("confidence_ceiling_ok")
    tests = {
        "missed_escalations": (F.col("missed_escalation"), F.col("id")),
        "false_escalations": (F.col("false_escalation"), F.col("id")),
        "urgency_under": (gap < 0, told),
        "urgency_over": (gap > 0, told),
        "urgency_hard_under": ((gap < 0) & ~F.array_contains("ambiguous", "urgency"), told),
        "overconfidence": (F.col("confidence_scored") & ~F.col("confidence_ceiling_ok"), over),
        "confidence_misses": (F.col("confidence_scored") & ~inside, miss),
    }
    wanted = [kind] if kind else OFFENCES
    none = F.array().cast("array<struct<kind:string,entry:string>>")
    entries = [
        F.when(tests[k][0], F.array(F.struct(F.lit(k).alias("kind"), tests[k][1].alias("entry")))).otherwise(none) for k in wanted
    ]
    return scores.select("id", F.inline(F.concat(*entries)))


HEADLINES = [
    "escalation_recall", "category_accuracy", "urgency_exact", "urgency_accuracy", "customer_accuracy", "identifier_accuracy",
]


def _headlines(card: DataFrame, name: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in HEADLINES])
    return card.select(F.inline(pairs))


def compare_scorecards(a: DataFrame, b: DataFrame) -> DataFrame:
    """The headline figures of two one-row scorecards side by side."""
    return _headlines(a, "a").join(_headlines(b, "b"), "metric")


def compare_runs_scorecards(scores: DataFrame, a: str, b: str) -> DataFrame:
    """``compare_scorecards`` of two runs out of scores with a ``run`` column: both cards from one pass over them."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in HEADLINES])
    cards = scorecard(scores.where(F.col("run").isin(a, b)), ["run"]).select("run", F.inline(pairs))
    return cards.groupBy("metric").agg(*[F.max(F.when(F.col("run") == run, F.col("value"))).alias(name) for name, run in (("a", a), ("b", b))])


def compare_runs_offenders(scores: DataFrame, a: str, b: str) -> DataFrame:
    """``compare_offenders`` of two runs out of scores with a ``run`` column."""
    kinds = {"missed_escalations": "missed_escalation", "false_escalations": "false_escalation"}
    found = F.filter(F.array(*[F.when(F.col(flag), F.lit(kind)) for kind, flag in kinds.items()]), lambda k: k.isNotNull())
    rows = scores.where(F.col("run").isin(a, b)).select("id", "run", F.explode(found).alias("kind"))
    return rows.groupBy("kind", "id").agg(F.bool_or(F.col("run") == a).alias("in_a"), F.bool_or(F.col("run") == b).alias("in_b"))


def compare_runs_answers(scores: DataFrame, a: str, b: str) -> DataFrame:
    """``compare_runs`` of two runs out of scores with a ``run`` column: labels meet by id, nothing is read again."""

    def label(side: Column) -> Column:
        return answer_label(side["category"], side["urgency"], side["escalate"])

    # No filter on the runs here: together with the last one it keeps the optimizer busy for a minute.
    rows = scores.select("id", "run", label(F.col("got")).alias("got"), label(F.col("expected")).alias("expected"))
    both = rows.groupBy("id").agg(
        *[F.max(F.when(F.col("run") == run, F.col("got"))).alias(name) for name, run in (("a", a), ("b", b))], F.max("expected").alias("expected")
    )
    return both.where(F.col("a") != F.col("b"))


def compare_offenders(a: DataFrame, b: DataFrame) -> DataFrame:
    """Missed and false escalations of two scored runs: which run has which."""
    kinds = ["missed_escalations", "false_escalations"]
    rows = offenders(a).select("kind", "id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        offenders(b).select("kind", "id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    return rows.where(F.col("kind").isin(kinds)).groupBy("kind", "id").agg(
        (F.max("a") > 0).alias("in_a"), (F.max("b") > 0).alias("in_b")
    )


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tickets two scored runs answer differently; ids only one run has are skipped."""

    def label(side: Column) -> Column:
        return answer_label(side["category"], side["urgency"], side["escalate"])

    left = a.select("id", label(F.col("got")).alias("a"), label(F.col("expected")).alias("expected"))
    right = b.select("id", label(F.col("got")).alias("b"))
    return left.join(right, "id").where(F.col("a") != F.col("b")).select("id", "a", "b", "expected")


def extraction_probe(scores: DataFrame) -> DataFrame:
    """Names right of all, identifiers found of those expected."""
    asked = F.coalesce(F.col("expected.identifier_contains"), F.lit("")) != ""
    return scores.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("customer_ok").alias("names_right"),
        F.count_if(asked).alias("identifiers_expected"),
        F.count_if(asked & F.col("identifier_ok")).alias("identifiers_found"),
    )


def keyword_free_probe(probe: DataFrame, decisions: DataFrame) -> DataFrame:
    """What a reader catches where the keywords are silent.

    ``leaked`` counts rows on which a guardrail fires after all; the probe holds only when it is 0.
    """
    d = decisions.select(
        F.col("ticket.external_id").alias("id"), F.col("extraction.escalate").alias("got"), F.size("rule_hits").alias("hits")
    )
    want, got = F.col("expect_escalate"), F.col("got")
    return probe.join(d, "id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(want).alias("must_catch"),
        F.count_if(want & got).alias("caught"),
        F.count_if(want & ~got).alias("missed"),
        F.count_if(~want & got).alias("false_positives"),
        F.count_if(F.col("hits") > 0).alias("leaked"),
        (F.count_if(F.col("hits") > 0) == 0).alias("precondition_holds"),
    )


def keyword_free_leaks(probe: DataFrame, decisions: DataFrame) -> DataFrame:
    """The probe rows a guardrail fires on, with the rules."""
    d = decisions.where(F.size("rule_hits") > 0).select(F.col("ticket.external_id").alias("id"), F.col("rule_hits.rule").alias("rules"))
    return probe.select("id").join(d, "id")


def adapt_probe(probe: DataFrame) -> DataFrame:
    """Probe rows as labelled rows: they test escalation, so category is free and urgency is low."""
    return probe.select(
        "id",
        F.lit("keyword-free").alias("group"),
        "text",
        F.struct(
            F.lit("other").alias("category"),
            F.lit("low").alias("urgency"),
            F.col("expect_escalate").alias("escalate"),
            F.lit(None).cast("string").alias("customer_name"),
            F.lit(None).cast("array<string>").alias("reasons"),
            F.lit(None).cast("string").alias("identifier_contains"),
            F.lit(None).cast("array<double>").alias("customer_confidence"),
        ).alias("expected"),
        F.array(F.lit("category")).alias("ambiguous"),
    )


def all_labelled(*labelled: DataFrame, probe: DataFrame | None = None) -> DataFrame:
    """Every labelled set as one, the probe adapted."""
    parts = [*labelled, *([adapt_probe(probe)] if probe is not None else [])]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def stress_report(scores: DataFrame) -> DataFrame:
    """Per attack row: did anything go wrong, and what was wanted and said?"""
    ok = ~F.col("missed_escalation") & ~F.col("false_escalation") & F.col("urgency_ok") & F.col("category_ok")

    def label(side: Column) -> Column:
        return F.concat_ws(
            "/", side["category"], side["urgency"], F.when(side["escalate"], F.lit("ESC")).otherwise(F.lit("no esc"))
        )

    return scores.select("id", label(F.col("expected")).alias("wanted"), label(F.col("got")).alias("got"), ok.alias("ok"))
