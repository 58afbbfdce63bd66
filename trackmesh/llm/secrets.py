"""Secret scans by a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived on the driver: every text that matches must
hold the trigrams of at least one of its conjunctions. The index, a written table, has the posting lists of just these
trigrams in lower-cased texts, cut into buckets of documents of bounded size. The lists of a conjunction are intersected
bucket by bucket, and candidates are verified by the rule itself. A rule without a mandatory trigram scans every text.

Places are found with split and regexp_extract_all, which cut the same leftmost non-overlapping matches: a match starts
after the gaps and matches before it. Places are code points, ends exclusive.

Cases: null text is the empty text and has no span; redact leaves it null. Null doc_ids share one posting, as do rows
that repeat a doc_id: they share candidates, never spans, as each row is verified on its own text. Spans that start
together are in the order of their kinds as listed. Very long texts are scanned whole. Other columns, whatever their
names, play no part and are kept by redact. Empty tables give no row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmesh.llm.common import doc_texts, input_bytes, materialize

try:  # the parser of re moved in Python 3.11
    from re import _constants as sre
    from re import _parser as parser
except ImportError:
    import sre_constants as sre
    import sre_parse as parser


@dataclass(frozen=True)
class Rule:
    """A kind of secret. group and least: the matched group that must have at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False

    @property
    def run_of_class(self) -> str | None:
        """The pattern with the length in it, for one repeated class: it drops the same matches, sooner."""
        return self.pattern[:-1] + "{%d,}+" % self.least if re.fullmatch(r"\[[^\\\]]+\]\+", self.pattern) and not self.group else None

    @property
    def java(self) -> str:
        return ("(?i)" if self.fold else "") + self.pattern


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: What the index adds: key blocks and the well-known prefixes of services' tokens.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("ghp", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE_RULES + MORE_RULES
#: Alternatives kept as exact strings while a query is derived; beyond it a part counts as unknown.
MOST_EXACT = 64
#: Input bytes (as stored) a bucket of posting lists; the doc_id that stands for null in them.
BUCKET_BYTES, NO_ID = 32 << 20, -(1 << 63)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Conjunctions of lower-case trigrams, one of which every match holds; None if there is no mandatory trigram."""
    query = _dnf(parser.parse(pattern))
    return None if any(not c for c in query) else sorted(query, key=sorted)


def _absorbed(query: list[frozenset[str]]) -> list[frozenset[str]]:
    """Without conjunctions that another one's trigrams imply; none at all stands for too many."""
    least = [c for c in set(query) if not any(o < c for o in query)]
    return least if len(least) <= MOST_EXACT else [frozenset.intersection(*least)]


def _grams(text: str) -> frozenset[str]:
    text = text.lower()
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _dnf(parsed) -> list[frozenset[str]]:
    """Walk a sequence: exact strings grow while they are few; where they end, their trigrams are kept."""
    done: list[frozenset[str]] = [frozenset()]
    exact: list[str] = [""]

    def close() -> None:
        nonlocal done, exact
        done = _absorbed([d | _grams(e) for d in done for e in exact])
        exact = [""]

    for op, arg in parsed:
        strings = _exact(op, arg)
        if strings is not None and len(strings) * len(exact) <= MOST_EXACT:
            exact = [e + s for e in exact for s in strings]
            continue
        close()
        if op is sre.SUBPATTERN:
            done = _absorbed([d | i for d in done for i in _dnf(arg[-1])])
        elif op is sre.BRANCH:
            done = _absorbed([d | i for d in done for branch in arg[1] for i in _dnf(branch)])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            done = _absorbed([d | i for d in done for i in _dnf(arg[2])])
    close()
    return done


def _exact(op, arg) -> list[str] | None:
    """All the strings that a part can match, if they are few."""
    if op is sre.LITERAL:
        return [chr(arg)]
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
        return [chr(a) for _, a in arg]
    if op is sre.SUBPATTERN:
        return _exact_all(arg[-1])
    if op is sre.BRANCH:
        parts = [_exact_all(b) for b in arg[1]]
        return None if any(p is None for p in parts) else [s for p in parts for s in p]
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
        inner = _exact_all(arg[2])
        return None if inner is None else [*([""] if arg[0] == 0 else []), *inner]
    return None


def _exact_all(parsed) -> list[str] | None:
    out = [""]
    for op, arg in parsed:
        strings = _exact(op, arg)
        if strings is None or len(out) * len(strings) > MOST_EXACT:
            return None
        out = [o + s for o in out for s in strings]
    return out


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index of the given trigrams, written once: (bucket, trigram, doc_ids)."""
    buckets = max(1, -(-input_bytes(docs) // BUCKET_BYTES))
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    postings = doc_texts(docs).select(_id().alias("doc_id"), F.explode(held).alias("trigram"))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")
    return materialize(postings.groupBy(bucket, "trigram").agg(F.collect_set("doc_id").alias("doc_ids")), "trigram-index")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and the kinds whose posting lists meet in it, of the rules that have mandatory trigrams."""
    lists = index.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "doc_ids"))).alias("lists"))  # at most all trigrams of the rules
    none = F.array().cast("array<bigint>")

    def meet(conjunction: frozenset[str]) -> Column:
        return reduce(F.array_intersect, [F.coalesce(F.try_element_at("lists", F.lit(t)), none) for t in sorted(conjunction)])

    found = [F.struct(F.lit(r.kind).alias("kind"), reduce(F.array_union, map(meet, query)).alias("ids")) for r in rules if (query := trigram_query(r.pattern))]
    each = lists.select(F.explode(F.array(*found)).alias("found")).select("found.kind", F.explode("found.ids").alias("doc_id"))
    return each.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _places(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind>> of a rule's matches in a text."""
    pattern = F.lit(rule.run_of_class or rule.java)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    lengths = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    counted = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    rows = F.arrays_zip(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("gap"), lengths.alias("length"), counted.alias("counted"))
    kind = F.lit(rule.kind)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["length"]
        one = F.array(F.struct(start.alias("start"), end.alias("end"), kind.alias("kind")))
        return F.struct(end.alias("at"), F.when(F.length(x["counted"]) >= rule.least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(rows, zero, step, lambda acc: acc["found"])


def _merge_places(parts: list[Column], rules: tuple[Rule, ...]) -> Column:
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    ranked = F.transform(F.flatten(F.array(*parts)), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(ranked)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The kept columns of docs and spans: array<struct<start, rank, end, kind>> in the order of start, then kind as listed."""
    indexed = [r for r in rules if trigram_query(r.pattern)]
    trigrams = sorted({t for r in indexed for c in trigram_query(r.pattern) for t in c})
    # written, so that its size is known: Spark broadcasts it below spark.sql.autoBroadcastJoinThreshold and else shuffles
    found = materialize(candidates(trigram_index(docs, trigrams), rules), "secret-candidates").withColumnRenamed("doc_id", "_candidate")
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_in_{c}") for c in keep], _id().alias("_doc"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.join(found, F.col("_doc") == F.col("_candidate"), "left")
    parts = []
    for r in rules:
        if r in indexed:
            due = F.array_contains("kinds", r.kind)
        else:
            due = F.rlike(F.col("_text"), F.lit(r.run_of_class or r.java))  # a scan of every text
        parts.append(F.when(due, _places(F.col("_text"), r)).otherwise(none))
    return rows.select(*[F.col(f"_in_{c}").alias(c) for c in keep], _merge_places(parts, rules).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    found = find_secrets(docs, keep=("doc_id",))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced; overlapping spans are replaced as one."""
    found = find_secrets(docs, keep=tuple(docs.columns))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text") - acc["at"]))
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.aggregate("spans", start, step, end))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def oracle_sql() -> str:
    """The same rows in DuckDB: gaps and matches by its own pattern functions."""
    low, parts = [], []
    for r in RULES:
        p = r.java.replace("'", "''")
        low.append(
            f"select doc_id, rid, '{r.kind}' kind, {RULES.index(r)} rank, unnest(range(1, len(m) + 1)) i, g, m, c from (select doc_id, rid, string_split_regex(text, '{p}') g, regexp_extract_all(text, '{p}', 0) m, regexp_extract_all(text, '{p}', {r.group}) c from docs)"
        )
        parts.append(r.least)
    least = " ".join(f"when {i} then {n}" for i, n in enumerate(parts))
    return f"""
with docs as (select doc_id, coalesce(text, '') as text, row_number() over () rid from documents),
hits as ({" union all ".join(low)}),
spans as (
  select rid, kind, rank, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as s, length(m[i]) as n, length(c[i]) as k
  from hits),
kept as (select rid, kind, rank, cast(s as bigint) s, cast(s + n as bigint) e from spans where k >= case rank {least} end),
sums as (
  select rid,
    count(*) filter (where rank = 0) as n_assign, count(*) filter (where rank = 1) as n_access, count(*) filter (where rank = 2) as n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (where rank < 3), '') as base,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank), '') as spans
  from kept group by rid)
select docs.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join sums using (rid)"""
