"""URL filter: host and path rules first, logistic regression on hashed character n-grams for the rest.

Rules are one expression, longest first: a comparison for each rule and url, meant for tens of rules. The classifier
sees runs of 3 to 5 characters of the host (borders marked) and of the path, each kind hashed apart, and is trained
from a small labelled url table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule (host and path together) that fits, as a struct (rule, verdict); null if none does.

    A rule fits its host and all subdomains, where the path starts with the rule's. Of two rules that are spelt the
    same, block wins.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0] != "block"))
    found = None
    for verdict, of_host, of_path in ordered:
        fits = ((host == of_host) | F.endswith(host, F.lit("." + of_host))) & F.startswith(path, F.lit(of_path))
        value = F.struct(F.lit(of_host + of_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def features(host: str, path: str, bits: int) -> np.ndarray:
    """Hashed distinct character n-grams of a host and a path."""
    out = set()
    for kind, text in ((b"h", f"^{host}$"), (b"p", path)):
        raw = text.encode("utf-8", "surrogatepass")
        for n in (3, 4, 5):
            out.update(zlib.crc32(kind + raw[i : i + n]) >> (32 - bits) for i in range(len(raw) - n + 1))
    return np.fromiter(out, np.int64, len(out))


def train(examples: list[tuple[str, str, int]], bits: int, epochs: int = 40, rate: float = 0.5, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from (host, path, 1 for block) examples, by adaptive gradient steps in a fixed mixed order."""
    weights, bias = np.zeros(1 << bits), 0.0
    squares, bias_square = np.full(1 << bits, 1e-6), 1e-6
    data = [(features(h, p, bits), y) for h, p, y in sorted(examples)]
    order = np.random.default_rng(3)
    for _ in range(epochs):
        for i in order.permutation(len(data)):
            at, y = data[i]
            scale = 1 / max(1.0, np.sqrt(len(at)))
            g = 1 / (1 + np.exp(-np.clip(bias + scale * weights[at].sum(), -35, 35))) - y
            step = g * scale + l2 * weights[at]
            squares[at] += step * step
            weights[at] -= rate * step / np.sqrt(squares[at])
            bias_square += g * g
            bias -= 0.1 * g / np.sqrt(bias_square)
    return weights, bias


def _judge(model, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            scores = []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                at = features(host, path, bits)
                z = bias + weights[at].sum() / max(1.0, np.sqrt(len(at)))
                scores.append(1 / (1 + np.exp(-np.clip(z, -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return run


def url_verdicts(pages: DataFrame, rules: list[Rule], labelled: DataFrame, bits: int = 16, examples: int = 20_000) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of `pages` (page_id, url).

    `labelled` is a table (url, block 0 or 1) of which the `examples` urls that hash lowest, at most, are learned; rows
    with a null in either column teach nothing. `score` is the classifier's chance to block, `verdict` the rule's or
    else block from 0.5 on. A null url has an empty host and path; null and repeated page_ids come out as they came in.
    Without examples the classifier allows all.
    """
    host, path = split_url(F.col("url"))
    known = labelled.where(F.col("url").isNotNull() & F.col("block").isNotNull()).select(host.alias("host"), path.alias("path"), F.col("block").cast("int").alias("y"))
    rows = known.distinct().orderBy(F.xxhash64("host", "path"), "host", "path", "y").limit(examples).toArrow().to_pylist()
    examples_ = [(r["host"], r["path"], r["y"]) for r in rows]
    weights, bias = train(examples_, bits) if len({y for *_, y in examples_}) == 2 else (np.zeros(1 << bits), -1.0)
    model = pages.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    scored = parts.mapInArrow(_judge(model, bits), "page_id long, host string, path string, score double")
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    return scored.withColumn("found", rule).select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "score",
    )


#: A small labelled table: what hosts and paths of junk and of plain sites look like. 1 is block. It names kinds of junk,
#: and no host of the tables it is tried on.
EXAMPLES: list[tuple[str, int]] = [
    *((f"https://{h}/{p}", 1) for h in (
        "royal-casino.com", "best-casino.net", "online-casino.org", "bets-bonus.com", "bet-now.net", "sports-bets.org", "poker-room.com",
        "jackpot-slots.net", "discount-pills.com", "pills-online.net", "buy-pills.org", "cheap-meds.com", "viagra-shop.net",
        "adult-clips.com", "adult-cams.net", "xxx-videos.org", "spam-mailer.com", "spam-links.net", "link-farm.org", "content-farm.com",
        "ads-clicks.com", "ad-tracker.net", "track-clicks.org", "banner-ads.com", "payday-loans.net", "free-loans.org", "win-prizes.com",
        "free-gift-cards.net", "crypto-doubler.org", "hot-singles.com",
    ) for p in ("", "en/1", "index.html", "page/2")),
    *((f"https://{h}/{p}", 0) for h in (
        "city-library.org", "town-news.com", "university.net", "science-museum.org", "open-data.net", "garden-club.com", "local-history.org",
        "weather-station.net", "recipes-daily.com", "bookshop.org", "parish-council.net", "mountain-rescue.org", "school.com", "hospital.org",
        "railway-times.com", "theatre.net", "choir.org", "river-trust.org", "orchestra.com", "farmers-market.net", "thimble.com", "thorin.net",
        "reading.org", "together.com", "another.net", "blog.writer.com", "www.painter.net", "m.gazette.org", "docs.manual.com", "news.herald.net",
    ) for p in ("", "en/1", "index.html", "page/2")),
]
