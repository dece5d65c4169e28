from __future__ import annotations

import os
import random

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
#: Extra columns whose names the operators use inside.
CLASHING = "score predicted component component_id set_id key n row ids epoch block host words line shard dim y".split()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("tables are not here")
    return SF


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): nulls in every column, empty and long texts, repeats, near copies, ties."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeilnorstu") for _ in range(rng.randint(2, 7)))
    base = [word() for _ in range(60)]
    near = [*base]
    near[30] = "changed"
    far = [word() for _ in range(60)]
    lines = "\n".join(["All rights reserved 2001.", " ".join(base[:8]), "ALL rights  reserved 2002."])
    rows = [
        (1, " ".join(base), "en", "a"), (2, " ".join(near), "en", "a"), (3, " ".join(base).upper(), "en", "b"),
        (4, " ".join(far), "fr", "b"), (5, None, "en", "a"), (6, "", None, "a"), (7, " \t\n\x0b\x0c\r ", "de", None),
        (8, "one two three", "en", "b"), (9, "One  two\tthree", "en", "c"), (None, " ".join(base), "en", "a"),
        (None, None, None, None), (10, "x", "en", None), (10, "x", "en", None), (11, lines, "en", "a"),
        (12, "é È ñ ß 漢字 ​ ́ \x85 \x1c don't DON'T <|endoftext|>", "fr", "c"), (13, "##$$ 12 !? ||", "de", "c"),
        (14, " ".join(word() for _ in range(20_000)), "en", "a"), (15, "same words here again " * 30, "en", "a"),
        (16, "long" * 50_000, "en", "b"), (1, " ".join(base), "en", "a"),
    ]
    for i in range(20, 40):
        text = [word() for _ in range(rng.randint(4, 30))]
        rows.append((i, " ".join(text), "en", "d"))
        for j in range(rng.randint(0, 3)):
            other = [*text]
            for _ in range(rng.randint(1, 3)):
                other[rng.randrange(len(other))] = word()
            rows.append((100 * i + j, " ".join(other) + rng.choice(["", " end", " " + word()]), "en", "d"))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    extra = ", ".join(f"`{c}` int" for c in CLASHING)
    rows = [(*r, len(r[1] or ""), *range(len(CLASHING))) for r in odd_rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture
def duck(odd_rows):
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    db.executemany("insert into documents values (?, ?, ?, ?)", odd_rows)
    return db


def plain(rows, columns):
    key = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(str(tuple(key(r[c]) for c in columns)) for r in rows)


def same_as_sql(frame, db, text):
    cursor = db.execute(text)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert plain(frame.collect(), sorted(names)) == plain(want, sorted(names))
