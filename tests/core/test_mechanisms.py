"""Calls that are taken up again, the audit as text in parts, counts while writing, the lookup in buckets."""

import pathlib
import uuid

import pytest
from pyspark.sql import functions as F

from fieldcanon.countries import country_table
from fieldcanon.operators import audit, external, lookup, stats
from fieldcanon.operators.standardize import standardize_analytics
from fieldcanon.registry import ERROR_LABEL, FIELDS

POSITIONS = "positions_designations"
KEYS = "field_key string, country string, raw string"


class CountingClient:
    """Writes down what it is asked; some values break the run or, for a time, the call."""

    def __init__(self, folder, bad=()):
        self.folder, self.bad = folder, bad

    def complete(self, system, user):
        values = [line.split(". ", 1)[1] for line in user.split("\n")[2:]]
        if any(v in self.bad for v in values):
            raise RuntimeError("broken")
        (pathlib.Path(self.folder) / uuid.uuid4().hex).write_text("\n".join(values))
        if "down" in values:
            raise external.TransientError("down")
        return "\n".join(f"{k}. {system} | HIGH" for k, _ in enumerate(values, 1))


def test_a_broken_run_is_taken_up_again(spark, tmp_path):
    """Answered requests aren't sent a second time, neither after a break nor in a later run; failed ones are."""
    calls = tmp_path / "calls"
    calls.mkdir()
    sent = lambda: sorted(p.read_text() for p in calls.iterdir())
    values = [f"v{n:02}" for n in range(6)] + ["down"]
    keys = spark.createDataFrame([(POSITIONS, "", v) for v in values], KEYS)
    book = external.ledger(spark, f"file://{tmp_path}/book")

    def run(name, bad=()):
        folder = str(calls)
        ask = external.external_classifier(lambda: CountingClient(folder, bad), {POSITIONS: "Director"}, f"{tmp_path}/{name}", batch_size=1, parallel=2, book=book, wave=3, base_delay=0.0, attempts=1)
        return {r.raw: r["std"] for r in ask(keys).collect()}

    with pytest.raises(Exception, match="broken"):
        run("first", ("v03",))
    entered, before = book.read().where("error is null").count(), len(sent())
    got = run("second")
    assert got == {v: ERROR_LABEL if v == "down" else "Director" for v in values}
    assert book.read().where("error is null").select("digest").distinct().count() == 6
    assert len(sent()) - before <= 7 - entered  # what was entered isn't sent again
    kept = len(sent())
    assert run("third") == got and len(sent()) == kept + 1  # the failed one only


def test_summary_in_parts(spark, tmp_path):
    """Parts may be cut anywhere: joined, they are the text."""
    labels = ["LEI", "VAT Number", "Tax ID Number"]
    rows = [(f, c, f"it's {n}" if n % 2 else f"raw {n:03}", labels[(n + k) % 3]) for f in ("brn_type", "business_status") for n in range(40) for k, c in enumerate(["A", "B", ""])]
    rows += [("brn_type", f"C{n:02}", "wide", labels[n == 0]) for n in range(12)]
    found = audit.audit_rows(spark.createDataFrame(rows, "field_key string, country string, raw string, std string"))
    want = []
    for field in [k for k in FIELDS if k in ("brn_type", "business_status")]:
        raws = sorted({r for f, _, r, _ in rows if f == field})
        want += ["\n" + "=" * 60, f"FIELD: {FIELDS[field][0]}  ({len(raws)} conflicting raw values)", "=" * 60]
        for raw in raws:
            want.append(f"\n  Raw: {raw!r}")
            for std in sorted({s for f, _, r, s in rows if (f, r) == (field, raw)}):
                places = sorted({c for f, c, r, s in rows if (f, r, s) == (field, raw, std)})
                want.append(f"    -> {std!r}  [{', '.join(places[:8])}{'...' if len(places) > 8 else ''}]")
    for size in (11, 100_000):
        texts = [r.text for r in sorted(audit.summary_parts(found, range_rows=size).collect(), key=lambda r: r.part)]
        assert "\n".join(texts) == "\n".join(want) and (len(texts) > 5) == (size == 11)
    audit.write_summary(audit.summary_parts(found, range_rows=50), f"{tmp_path}/summary")
    files = sorted(p for p in (tmp_path / "summary").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in files) == "\n".join(want) + "\n"


def test_observed_while_writing(spark, tmp_path):
    """The counts of the writing pass are those of ``run_stats``."""
    rows = [("Business Legal Form", "LLC"), ("Business Legal Form", " "), ("business legal form ", "zz"), ("BRN Type", None), ("Mystery", "x"), (None, "y"), ("Mystery", None)]
    path = f"{tmp_path}/raw"
    spark.createDataFrame([(n, "224", t, v) for n, (t, v) in enumerate(rows * 3)], "row_id int, countryId string, fieldType string, inputText string").write.parquet(path)
    out = standardize_analytics(spark.read.parquet(path), country_table(spark), keep_keys=True)
    seen_rows, seen = stats.observed(out, "fieldType")
    seen_rows.drop("_key", "_answer").write.parquet(f"{tmp_path}/out")
    got = {(r.type_text, r.field_key): (r.total_rows, r.blanks, r.flagged) for r in stats.observed_stats(spark, seen).collect()}
    want: dict = {}
    for r in stats.run_stats(out, "fieldType").collect():
        key = (r.field_type.strip().lower() if r.field_key else None, r.field_key)
        want[key] = tuple(a + b for a, b in zip(want.get(key, (0, 0, 0)), (r.total_rows, r.blanks, r.flagged)))
    assert got == want and sum(v[0] for v in got.values()) == 21


def test_lookup_in_buckets(spark):
    entries = [("brn_type", "consistent", "", "a", "LEI"), ("brn_type", "by_country", "France", "a", "VAT Number"), ("brn_type", "by_country", "", "b", "LEI"), (POSITIONS, "by_country", "Malta", "ceo", "Board Member")]
    table = spark.createDataFrame(entries, "field_key string, tier string, country string, raw string, std string")
    keys = spark.createDataFrame([(f, c, r) for f in ("brn_type", POSITIONS) for c in ("", "France", "Malta") for r in ("a", "b", "ceo")], KEYS)
    name = f"lookup_{uuid.uuid4().hex}"
    lookup.save_buckets(table, name, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lookup.resolve_buckets(keys, name)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and name not in plan.split("Exchange hashpartitioning")[1].split("Scan ExistingRDD")[0]
        want = lookup.resolve(keys, table).select(got.columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"drop table {name}")
