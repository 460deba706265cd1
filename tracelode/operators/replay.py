"""Sequence logic that no SQL operator expresses: edit replay, sequence diff, fuzzy match."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RECOVERED = "path string, content string, applied int, skipped int, integrity double"


def _replay(key, ops: pd.DataFrame) -> pd.DataFrame:
    ops = ops.sort_values("seq")
    writes = ops.index[ops["kind"] == "write"]
    if not len(writes):
        return pd.DataFrame([(key[0], None, 0, int((ops["kind"] == "edit").sum()), 0.0)], columns=["path", "content", "applied", "skipped", "integrity"])
    base = ops.loc[writes[-1]]
    content, applied, skipped = base["content"] or "", 0, 0
    for o in ops[(ops["seq"] > base["seq"]) & (ops["kind"] == "edit")].itertuples():
        if o.old and o.old in content:
            content = content.replace(o.old, o.new or "", -1 if o.replace_all else 1)
            applied += 1
        else:
            skipped += 1
    share = applied / (applied + skipped) if applied + skipped else 1.0
    return pd.DataFrame([(key[0], content, applied, skipped, share)], columns=["path", "content", "applied", "skipped", "integrity"])


def recovered(ops: DataFrame) -> DataFrame:
    """Files from operations(path, seq, kind write|edit, content, old, new, replace_all): the last write, and the edits after it in order.

    A group is one file's operations. An edit whose text isn't there is skipped; without a write nothing can be recovered.
    """
    return ops.groupBy("path").applyInPandas(_replay, RECOVERED)


#: From so many places on, an element's places are kept as one number; with fewer that number is made when needed.
FREQUENT = 64


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """For each j, the length of a longest common subsequence of a and b[:j]; a bit for each place of b, all in one number."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    kept: dict[int, int] = {}
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        at = places.get(x)
        if at is None:
            continue
        mask = kept.get(x)
        if mask is None:
            if len(at) < FREQUENT:
                mask = sum(1 << j for j in at)
            else:
                bits = np.zeros(len(b), np.uint8)
                bits[at] = 1
                mask = kept[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        hit = row & mask
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes((len(b) + 7) // 8, "little"), np.uint8), bitorder="little", count=len(b))
    return np.concatenate(([0], np.cumsum(1 - bits, dtype=np.int64)))


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence, in order.

    The first sequence is halved and the second cut where the two halves' lengths add up to most, so the memory is
    linear; the lengths take time by the product of the sequences over the bits of a machine word. Elements that the
    other side hasn't, and equal ends, are set apart first.
    """
    code: dict = {}
    x, y = ([code.setdefault(v, len(code)) for v in side] for side in (a, b))
    in_x, in_y = set(x), set(y)
    px, py = [i for i, v in enumerate(x) if v in in_y], [j for j, v in enumerate(y) if v in in_x]
    out: list[tuple[int, int]] = []
    todo = [(0, len(px), 0, len(py))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and x[px[a0]] == y[py[b0]]:
            out.append((px[a0], py[b0]))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and x[px[a1 - 1]] == y[py[b1 - 1]]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((px[a1], py[b1]))
        if a0 == a1 or b0 == b1:
            continue
        left, right = [x[i] for i in px[a0:a1]], [y[j] for j in py[b0:b1]]
        if len(left) == 1:
            if left[0] in right:
                out.append((px[a0], py[b0 + right.index(left[0])]))
            continue
        half = len(left) // 2
        cut = int((_lengths(left[:half], right) + _lengths(left[half:][::-1], right[::-1])[::-1]).argmax())
        todo += [(a0, a0 + half, b0, b0 + cut), (a0 + half, a1, b0 + cut, b1)]
    return sorted(out)


def sequence_diff(first: DataFrame, second: DataFrame, by: str, order: str, mark: str) -> DataFrame:
    """(by, side, pos, mark) of both sides' sequences: side is common, removed or added. A group is one pair of sequences."""

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = (t.sort_values(order)[mark].astype(str).tolist() for t in (a, b))
        pairs = common(x, y)
        in_x, in_y = {i for i, _ in pairs}, {j for _, j in pairs}
        rows = [(key[0], "common" if i in in_x else "removed", i, v) for i, v in enumerate(x)]
        rows += [(key[0], "added", i, v) for i, v in enumerate(y) if i not in in_y]
        return pd.DataFrame(rows, columns=[by, "side", "pos", mark])

    kind = dict(first.dtypes)[by]
    # columns of their own, also where both sides come from one table
    first, second = (side.select(*[F.col(c).alias(c) for c in dict.fromkeys((by, order, mark))]) for side in (first, second))
    return first.groupBy(by).cogroup(second.groupBy(by)).applyInPandas(run, f"{by} {kind}, side string, pos int, {mark} string")


def hunks(a: list[str], b: list[str], context: int = 3) -> tuple[int, int, int, str]:
    """(added, removed, unchanged, unified diff) of two texts' lines; stretches up to twice the context apart share a hunk."""
    edits: list[tuple[str, int, int]] = []  # (sign, line of a, line of b)
    i = j = 0
    pairs = common(a, b)
    for p, q in [*pairs, (len(a), len(b))]:
        edits += [("-", k, j) for k in range(i, p)] + [("+", p, k) for k in range(j, q)]
        if p < len(a) and q < len(b):
            edits.append((" ", p, q))
        i, j = p + 1, q + 1
    changed = [n for n, e in enumerate(edits) if e[0] != " "]
    spans: list[list[int]] = []
    for n in changed:
        low, high = max(0, n - context), min(len(edits), n + context + 1)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = high
        else:
            spans.append([low, high])
    out = []
    for low, high in spans:
        part = edits[low:high]
        n, m = sum(e[0] != "+" for e in part), sum(e[0] != "-" for e in part)
        out.append(f"@@ -{part[0][1] + (n > 0)},{n} +{part[0][2] + (m > 0)},{m} @@")
        out += [s + (b[q] if s == "+" else a[p]) for s, p, q in part]
    return len(b) - len(pairs), len(a) - len(pairs), len(pairs), "".join(x + "\n" for x in out)


DIFF = "added int, removed int, unchanged int, diff string"


def text_diffs(rows: DataFrame, before: str, after: str) -> DataFrame:
    """rows with added, removed, unchanged (lines) and diff, a unified diff with three lines around; a null text has no lines."""
    new = [f.split()[0] for f in DIFF.split(", ")]
    rows = rows.select(*[c for c in rows.columns if c not in new])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lines = lambda t: t.removesuffix("\n").split("\n") if t else []
            found = [hunks(lines(x), lines(y)) for x, y in zip(b[before], b[after], strict=True)]
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(found, columns=new)], axis=1)

    return rows.mapInPandas(run, StructType([*rows.schema.fields, *StructType.fromDDL(DIFF).fields]))


def backups(spark: SparkSession, path: str) -> DataFrame:
    """(path, version, modified, size, content) of backup files `home-user-file-hash.bak`: versions of a path by time, from 1. Spark lists no empty files."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.bak").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)-[^/-]*\.bak$", 1)
    f = f.filter(name != "").select(F.replace(name, F.lit("-"), F.lit("/")).alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.col("content").cast("string").alias("content"), F.col("path").alias("file"))
    w = Window.partitionBy("path").orderBy("modified", "file")
    return f.withColumn("version", F.row_number().over(w)).select("path", "version", "modified", "size", "content")


def version_diffs(versions: DataFrame) -> DataFrame:
    """(path, version, added, removed, unchanged, diff): each version(path, version, content) but the first against the one before."""
    w = Window.partitionBy("path").orderBy("version")
    pairs = versions.select("path", "version", F.lag("version").over(w).alias("was_version"), F.lag("content").over(w).alias("was"), "content").filter("was_version is not null")
    return text_diffs(pairs, "was", "content").drop("was", "content", "was_version")


def at_version(versions: DataFrame, n: int) -> DataFrame:
    """(path, content) of the version n, of paths that have one: each is whole."""
    return versions.filter(F.col("version") == n).select("path", "content")


def fuzzy_score(pattern: str, text: str | None, ignore_case: bool = True) -> int | None:
    """0 to 100 where the pattern's characters follow each other in the text, else null.

    Greedy from the left. Half of the score is for the match itself; the rest for consecutive characters, word
    starts, equal case where case counts, and how dense the match is.
    """
    if not pattern or text is None:
        return None
    p, t = (pattern.lower(), text.lower()) if ignore_case else (pattern, text)
    at, found = 0, []
    for c in p:
        at = t.find(c, at)
        if at < 0:
            return None
        found.append(at)
        at += 1
    n = len(found)
    near = sum(b == a + 1 for a, b in zip(found, found[1:], strict=False)) / max(1, n - 1)
    starts = sum(i == 0 or not t[i - 1].isalnum() for i in found) / n
    exact = 0 if ignore_case else sum(text[i] == c for i, c in zip(found, pattern, strict=True) if i < len(text)) / n
    dense = (n / (found[-1] - found[0] + 1) - 0.5) * 10 if n > 1 else 0
    return int(max(0, min(100, 50 + 25 * near + 15 * starts + 5 * exact + dense)))


def fuzzy_matches(texts: DataFrame, text_col: str, pattern: str, threshold: int = 60) -> DataFrame:
    """Rows whose text matches with at least this score; rows without the characters in order never reach Python."""
    import re

    # each gap excludes the character that ends it, so the expression never goes back over the text
    likely = F.col(text_col).rlike("(?is)^" + "".join(f"[^{re.escape(c)}]*{re.escape(c)}" for c in pattern))

    @F.pandas_udf("int")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series([fuzzy_score(pattern, x) for x in s], dtype="Int32")

    return texts.filter(likely).withColumn("score", score(text_col)).filter(F.col("score") >= threshold)
