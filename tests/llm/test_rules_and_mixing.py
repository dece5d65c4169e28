"""Quality rules and source mixing against their SQL, and the pipeline stage by stage."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import same_as_sql
from tests.llm.test_jaccard_join import brute
from weekgrid.llm import mixing, queries, quality_rules, sql


def with_limits(text, docs, removed):
    return text.replace("count(distinct text) > 50", f"count(distinct text) > {docs}").replace("<= 50 * n_words", f"<= {removed} * n_words")


@pytest.mark.parametrize("docs, removed", [(50, 50), (1, 50), (1, 10), (0, 99)])
def test_rules_by_sql(odd, duck, docs, removed):
    same_as_sql(quality_rules.quality_rules(odd, docs, removed), duck, with_limits(sql.QUALITY_RULES, docs, removed))


def test_rules_on_the_table(spark, sf):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view documents as from '{sf}/documents.parquet'")
    same_as_sql(queries.op7_quality_rules(spark, sf), db, sql.QUALITY_RULES)
    same_as_sql(queries.op10_mixing(spark, sf), db, sql.MIXING)


@pytest.mark.parametrize("most", [0, 1, 2])
def test_common_lines_leave_the_texts(spark, odd, none, most):
    import re
    from collections import defaultdict

    rows = [
        (1, "Keep me one\nAll rights Reserved 2001\n\n  tail ", "a", 7), (2, "ALL  rights\treserved 1999\nkeep two", "a", 7),
        (3, "all rights reserved 5", "a", 7), (4, "all rights reserved 5", "b", 7), (5, None, "a", 7), (6, "", None, 7), (3, "all rights reserved 5", "a", 7),
        (8, "keep two", None, 7), (9, "x\nkeep two", None, 7), (10, "keep two\ny", None, 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, line int").repartition(3)
    normal = lambda line: re.sub("[0-9]+", "0", " ".join(w for w in re.split("[ \t\n\x0b\x0c\r]+", line.lower()) if w))
    seen = defaultdict(set)
    for _, text, source, _ in rows:
        for line in (text or "").split("\n"):
            if normal(line):
                seen[source, normal(line)].add(text)
    clean = lambda text, source: text and "\n".join(x for x in text.split("\n") if not normal(x) or len(seen[source, normal(x)]) <= most)
    got = quality_rules.without_common_lines(docs, most)
    assert got.columns == docs.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((i, clean(t, s), s, n)) for i, t, s, n in rows)
    assert quality_rules.without_common_lines(odd, 1).count() == odd.count() and quality_rules.without_common_lines(none).collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_verdicts_come_from_the_texts_that_are_left(spark, odd, monkeypatch):
    """The operator gives the texts without common lines, and the counts follow what has left them."""
    long = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{long}\n\nShared line 1", "a"), (2, "shared  LINE 22\nnine more words to make this text long enough here", "a"), (3, "shared line 3", "b"), (4, None, "a"), (5, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.removed_words, r.kept) for r in quality_rules.cleaned(docs, 1).collect()}
    assert got == {1: (f"{long}\n", 3, True), 2: (rows[1][1].split("\n")[1], 3, True), 3: ("shared line 3", 0, False), 4: (None, 0, False), 5: ("", 0, False)}
    apart = lambda frame: sorted(map(str, frame.select("doc_id", "text").collect()))
    assert apart(quality_rules.cleaned(odd, 1)) == apart(quality_rules.without_common_lines(odd, 1))
    assert sum(r.removed_words for r in quality_rules.quality_rules(docs, 1).collect()) == 6
    monkeypatch.setattr(quality_rules, "without_places", lambda text, gone: text)
    assert sum(r.removed_words for r in quality_rules.quality_rules(docs, 1).collect()) == 0


def test_rules_empty(none):
    assert quality_rules.quality_rules(none).collect() == []


def test_no_python_in_native_plans(spark, sf):
    for build in (queries.op7_quality_rules, queries.op10_mixing):
        plan = build(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow")), plan


COLUMNS = ("doc_id", "source")


def mixed_rows(frame):
    part = [F.col(f"_mix.{n}").alias(n) for n in ("epoch", "block", "place")]
    return frame.select(*COLUMNS, *part, *(F.round(f"_mix.{n}", 6).alias(n) for n in ("weight", "repetition", "alpha")))


def test_mixing_by_sql(odd, duck):
    same_as_sql(mixed_rows(mixing.mix(odd, repetition=2.0)), duck, sql.MIXING)


def test_everything_stays_and_nothing_is_repeated_more(odd, odd_rows):
    mixed = mixing.mix(odd, repetition=3.0)
    assert mixed.columns == [*odd.columns, "_mix"]
    got = Counter((r.doc_id, r.source, r["_mix"].epoch) for r in mixed.collect())
    want = Counter((d, s, 1) for d, _, _, s in odd_rows)
    assert {k: n for k, n in got.items() if k[2] == 1} == want
    assert max(k[2] for k in got) == 3 and all(n <= want[k[0], k[1], 1] for k, n in got.items())


def test_target_entropy(odd):
    shares = [0.5, 0.3, 0.2]
    spark = odd.sparkSession
    table = spark.createDataFrame([(p,) for p in shares], "p double")
    for target in (1.03, 1.06, 1.09):
        a = mixing.bisect(table, target, None)
        q = [p**a for p in shares]
        w = [x / sum(q) for x in q]
        assert -sum(x * math.log(x) for x in w) == pytest.approx(target, abs=1e-6)
    assert mixing.bisect(table, 2.0, None) == 0.0 and mixing.bisect(table, 0.5, None) == 1.0
    assert mixing.bisect(table, None, 2.0) == pytest.approx(1 - math.log(2) / math.log(2.5), abs=1e-6)
    assert mixing.bisect(table, None, 9.0) == 0.0


def test_budget(odd, odd_rows):
    rows = mixing.mix(odd, repetition=2.0, budget=3000).collect()
    words = {(d, s): len((t or "").split()) for d, t, _, s in odd_rows}
    total = sum(words[r.doc_id, r.source] for r in rows)
    assert 0 < total <= 3000 + 20_000  # blocks are whole; one document here has 20,000 words
    with pytest.raises(ValueError):
        mixing.mix(odd)


def test_mixing_empty(none):
    assert mixing.mix(none, repetition=2.0).collect() == mixing.mix(none, entropy=1.0).collect() == []


def test_stages_keep_columns_and_take_effect(spark, sf, odd, odd_rows):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "jaccard_join", "mixing", "bpe"]
    stages = dict(corpus_pipeline.STAGES)
    for name in names[:-1]:
        assert stages[name](spark, odd, sf).columns == odd.columns
    near = sorted(r.doc_id for r in stages["jaccard_join"](spark, odd, sf).where("doc_id is not null").collect())
    assert near == sorted({d for d, _, c in brute(odd_rows) if d is not None and d == c})
    texts = dict((d, t) for d, t, *_ in odd_rows)
    kept = {r.doc_id for r in stages["language_id"](spark, odd, sf).collect()}
    assert not kept & {d for d, t in texts.items() if d is not None and not any(c.isalpha() for c in t or "")}


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        want = spark.createDataFrame(stage(spark, want, sf).collect(), docs.schema)
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in want.collect())
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    kept = {r.doc_id for r in want.collect()}
    assert len(toxic & kept) <= 0.1 * len(toxic)
