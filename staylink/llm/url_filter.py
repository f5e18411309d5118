"""URL verdicts: host and path rules, else logistic regression on hashed character n-grams.

The model is trained on a small labelled URL table (fixed below, or the caller's; at
most MAX_LABELS rows), on hashed character 3- to 5-grams of host and path. Its weights
are 2**BITS floats: a fixed size, sent to every task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylink.llm.shared import columns

BITS = 16
#: Labelled rows that a fit reads at most.
MAX_LABELS = 20_000

# Rules as (verdict, host, path prefix). The longest that fits wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# The small labelled URL table (1: block).
LABELLED = (
    ("http://spam-farm.example.org/en/1", 1), ("http://best-casino-bonus.example.org/win/now", 1),
    ("http://cheap-pills-online.example.org/buy/viagra", 1), ("http://free-xxx-cams.example.org/live", 1),
    ("http://win-lottery-prize.example.org/claim?id=1", 1), ("http://adult-dating-hot.example.org/join", 1),
    ("http://replica-watches-sale.example.org/rolex/cheap", 1), ("http://click-track-ads.example.org/redirect/out", 1),
    ("http://payday-loans-fast.example.org/apply-now", 1), ("http://seo-link-farm.example.org/links/exchange", 1),
    ("http://spam-links.example.org/de/buy", 1), ("http://poker-slots-jackpot.example.org/bonus", 1),
    ("http://torrent-warez-crack.example.org/keygen", 1), ("http://phish-login-verify.example.org/account/update", 1),
    ("http://doorway-spam.example.org/fr/777", 1), ("http://hot-deals-discount.example.org/buy-cheap", 1),
    ("http://www.library.example.org/en/catalogue", 0), ("http://news.example.org/de/2020/politik", 0),
    ("http://docs.example.org/manual/install.html", 0), ("http://blog.example.org/fr/recettes", 0),
    ("http://museum.example.org/es/historia", 0), ("http://www.university.example.org/en/research/papers", 0),
    ("http://m.weather.example.org/de/berlin", 0), ("http://wiki.example.org/fr/Article", 0),
    ("http://school.example.org/en/lessons/12", 0), ("http://forum.example.org/en/thread/345", 0),
    ("http://radio.example.org/es/programas", 0), ("http://city.example.org/de/rathaus", 0),
    ("http://health.example.org/en/guides/sleep.html", 0), ("http://www.garden.example.org/en/roses/", 0),
    ("http://blog.travel.example.net/en/lisbon", 0), ("http://science.example.net/de/physik", 0),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or url."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; null where none fits. The root rule of a
    host (path /) needs a path that starts with /."""
    rule = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for kind, domain, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        rule, verdict = F.when(fits, domain + prefix).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def ngrams(host: str, path: str) -> np.ndarray:
    """Slots of the distinct character 3- to 5-grams of host and path, each part by itself."""
    text = [f"h^{host}$".encode(), f"p^{path}$".encode()]
    found = {part[:1] + part[i : i + n] for part in text for n in (3, 4, 5) for i in range(1, len(part) - n + 1)}
    return np.unique(np.array([zlib.crc32(g) & ((1 << BITS) - 1) for g in found], np.int64)) if found else np.zeros(0, np.int64)


def train(labelled: list[tuple[str, str, int]], epochs: int = 200, rate: float = 0.5, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch gradient descent (deterministic)."""
    if len(labelled) > MAX_LABELS:
        raise ValueError(f"the labelled URL table holds at most {MAX_LABELS} rows")
    rows = [ngrams(h, p) for h, p, _ in labelled]
    which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    slot = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    y = np.array([v for _, _, v in labelled], float)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(which, minlength=len(rows))))
    w, b = np.zeros(1 << BITS), 0.0
    for _ in range(epochs if len(rows) else 0):
        z = np.bincount(which, w[slot], len(rows)) * scale + b
        g = (1 / (1 + np.exp(-z)) - y) / len(rows)
        w -= rate * len(rows) ** 0.5 * (np.bincount(slot, (g * scale)[which], 1 << BITS) + penalty * w)
        b -= rate * g.sum()
    return w, b


def split_url(url: str) -> tuple[str, str]:
    """host and path as host_of and path_of have them, for the driver's small labelled table."""
    import re

    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (m[1].translate(lower), m[2]) if m else ("", "")


def judge(pages: DataFrame, labelled=LABELLED, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row.

    score is the model's probability of block, also where a rule decides. Null urls and
    urls without :// have empty host and path: no rule fits them, so the model judges.
    Repeated rows are judged one by one; other columns are ignored.
    """
    w, b = train([(*split_url(u), v) for u, v in labelled])
    kind = pages.schema[id_col].dataType.simpleString()
    url = F.col("url")
    parts = columns(pages, page_id=id_col, url=url_col).select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [ngrams(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            z = [b + w[r].sum() / max(1, len(r)) ** 0.5 for r in rows]
            yield batch.append_column("score", pa.array(1 / (1 + np.exp(-np.array(z, float)))))

    scored = parts.mapInArrow(score, f"page_id {kind}, host string, path string, score double")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
