"""Filtering of URLs by host rules and a weighted vocabulary.

A rule names a host and the start of a path; it holds for the host and its subdomains, and the longest rule
that fits decides. Where none fits, the vocabulary does: an Aho-Corasick automaton finds all terms in one pass
over the lower-cased URL, a hit counts only between characters that are no letters or digits, one strict term
rejects, and so do soft terms whose distinct weights reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

#: Terms of which one rejects a URL.
STRICT = (
    "porn", "porno", "xxx", "xvideos", "hentai", "milf", "bdsm", "camgirl", "camgirls", "escort", "escorts", "livesex", "sexcam", "sexchat", "hardcore",
    "warez", "keygen", "keygens", "cracks", "serialz", "nulled", "phishing", "malware", "ransomware", "botnet", "carding", "skimmer", "darkmarket",
    "onlinecasino", "freeslots", "buyviagra", "cialis", "steroids", "fakeid", "payday",
)
#: Terms with their weights; distinct ones add up to SOFT_LIMIT. None reaches it alone.
SOFT = {
    "sex": 1.5, "sexy": 1.5, "nude": 1.5, "naked": 1.5, "erotic": 1.5, "viagra": 1.5, "casino": 1.25, "casinos": 1.25, "adult": 1.0, "adults": 0.75, "fetish": 1.5, "lingerie": 1.0,
    "webcam": 1.0, "dating": 1.0, "singles": 0.75, "hookup": 1.5, "poker": 1.0, "slots": 1.0, "roulette": 1.0, "jackpot": 1.0, "betting": 1.0, "bets": 0.75, "gambling": 1.0, "lottery": 0.75,
    "bonus": 0.5, "free": 0.25, "cheap": 0.5, "deal": 0.25, "discount": 0.25, "win": 0.25, "prize": 0.5, "pills": 1.0, "pharmacy": 0.75, "prescription": 0.5, "weightloss": 1.0, "detox": 0.5,
    "loan": 0.75, "loans": 0.75, "credit": 0.25, "cash": 0.5, "crypto": 0.5, "bitcoin": 0.5, "forex": 0.75, "torrent": 1.0, "torrents": 1.0, "crack": 1.25, "cracked": 1.25, "serial": 0.75,
    "download": 0.25, "stream": 0.25, "replica": 1.0, "rolex": 1.0, "spyware": 1.25, "hack": 0.75, "hacked": 0.75, "exploit": 0.5, "tracker": 0.25, "popup": 0.75, "clickbait": 1.0,
}
SOFT_LIMIT = 2
#: The rules of the query: verdict and rule.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...] = STRICT
    soft: Mapping[str, float] = field(default_factory=lambda: dict(SOFT))
    soft_limit: float = SOFT_LIMIT

    @classmethod
    def read(cls, spark: SparkSession, path: str, soft_limit: float = SOFT_LIMIT) -> Vocabulary:
        """From text files of lines `strict<TAB>term` and `weight<TAB>term`, wherever Spark reads; blank lines and those that begin with # don't count."""
        strict, soft = [], {}
        for (line,) in spark.read.text(path).collect():  # a vocabulary is a list for one automaton in each worker
            if line.strip() and not line.startswith("#"):
                kind, _, term = line.partition("\t")
                if not term.strip():
                    raise ValueError(f"{path}: no term in {line!r}")
                if kind == "strict":
                    strict.append(term.strip())
                else:
                    soft[term.strip()] = float(kind)
        return cls(tuple(strict), soft, soft_limit)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, weight in [*self.soft.items(), *((t, None) for t in self.strict)]:
            if term:
                a.add_word(term.lower(), (term.lower(), weight))
        a.make_automaton()
        return a


def hits(automaton, text: str) -> tuple[int, dict[str, float]]:
    """Strict hits, and distinct soft terms with their weights, of lower-case text."""
    strict, soft = 0, {}
    for end, (term, weight) in automaton.iter(text) if len(automaton) else ():
        start = end - len(term) + 1
        if (start and text[start - 1].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
            continue
        if weight is None:
            strict += 1
        else:
            soft[term] = weight
    return strict, soft


def rule_index(rules: Iterable[tuple[str, str]]) -> dict[str, list[tuple[str, str, str]]]:
    """host -> (path, rule, verdict), the longest path first. A lookup takes a URL's labels, however many rules there are."""
    index: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        index.setdefault(host.lower(), []).append((slash + path, rule, verdict))
    for found in index.values():
        found.sort(key=lambda x: -len(x[0]))
    return index


def fitting(index: Mapping[str, list[tuple[str, str, str]]], host: str, path: str) -> tuple[str, str] | None:
    """The longest rule that fits, with its verdict."""
    best = None
    rest = host
    while rest:
        for start, rule, verdict in index.get(rest, ()):
            if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                best = (rule, verdict)
                break
        rest = rest.partition(".")[2]
    return best


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without '://'."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))
    return lower_ascii(rest), path


def judge_urls(df: DataFrame, id_col: str, url_col: str, rules: Iterable[tuple[str, str]] = RULES, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Judges every row's URL; one narrow pass without a shuffle.

    Returns id, host, path, rule (null if none fits), verdict (allow or block), strict_hits, soft_hits (distinct
    terms) and soft_weight. A null or empty URL, or one without '://', has an empty host and path and fits no
    rule; the vocabulary still sees the whole URL. Repeated rows each get a row; other columns are left out, so
    their names can't clash. The vocabulary and the rules go to the workers with the task: both are parameters
    (Vocabulary.read() takes files). A term that is listed as strict and soft is strict.
    """
    index, vocabulary = rule_index(rules), vocabulary or Vocabulary()
    url = F.col(f"`{url_col}`")
    host, path = host_path(url)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), url.alias("url"), host.alias("host"), path.alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = vocabulary.automaton()
        for b in batches:
            out: list[tuple] = []
            for url, h, p in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                strict, soft = hits(automaton, (url or "").lower())
                weight = float(sum(soft.values()))
                rule, verdict = fitting(index, h, p) or (None, "block" if strict or weight >= vocabulary.soft_limit else "allow")
                out.append((rule, verdict, strict, len(soft), weight))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            arrays = [b.column(0), b.column(2), b.column(3), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight"])

    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string, strict_hits long, soft_hits long, soft_weight double")
    return out.withColumnRenamed("id", id_col)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under RULES and the default vocabulary."""
    return judge_urls(table(spark, sf_dir, "pages"), "page_id", "url")


def _sql() -> str:
    def bounded(term: str) -> str:
        # \b holds beside '_' only between other word characters; letters and digits are what counts here.
        return rf"regexp_matches(lower(coalesce(url, '')), '(^|[^\p{{L}}\p{{N}}]){term}([^\p{{L}}\p{{N}}]|$)')"

    def occurrences(term: str) -> str:
        # a neighbour may end one hit and begin the next, so each separator is doubled first
        text = r"regexp_replace(lower(coalesce(url, '')), '([^\p{L}\p{N}])', '\1\1', 'g')"
        return rf"len(regexp_extract_all({text}, '(^|[^\p{{L}}\p{{N}}]){term}([^\p{{L}}\p{{N}}]|$)'))"

    strict = " + ".join(occurrences(t) for t in STRICT)
    soft = " + ".join(f"cast({bounded(t)} as int)" for t in SOFT)
    weight = " + ".join(f"{w} * cast({bounded(t)} as int)" for t, w in SOFT.items())
    cases = []
    for verdict, rule in sorted(RULES, key=lambda x: -len(x[1])):
        h, slash, p = rule.partition("/")
        cases.append((f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{slash}{p}')", rule, verdict))
    rule_sql = "case " + " ".join(f"when {c} then '{r}'" for c, r, _ in cases) + " end"
    verdict_sql = "case " + " ".join(f"when {c} then '{v}'" for c, _, v in cases)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with parts as (
  select page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 1), ''), '{upper}', '{lower}') as host,
    coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
counted as (
  select *, cast({strict} as bigint) as strict_hits, cast({soft} as bigint) as soft_hits, cast({weight} as double) as soft_weight from parts)
select page_id, host, path, {rule_sql} as rule,
  {verdict_sql} when strict_hits > 0 or soft_weight >= {SOFT_LIMIT} then 'block' else 'allow' end as verdict,
  strict_hits, soft_hits, soft_weight
from counted"""


SQL = _sql()
