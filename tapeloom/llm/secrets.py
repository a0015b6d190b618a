"""Secret scans over a trigram inverted index, in DataFrame operations only."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_few, stored

MOST_STRINGS = 64
SMALL_CLASS = 4


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and don't overlap; those whose group is shorter than `least` characters are dropped.
    fold: letters outside classes stand for either case (A-Z only)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False

    def regex(self) -> str:
        """The pattern for Java; fold doesn't touch classes, which state both cases."""
        return f"(?i){self.pattern}" if self.fold else self.pattern


# The base rules, in their order of listing.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("url_password", r"://[A-Za-z0-9._-]+:[^\x20\x09-\x0D/@:]+@"),
    Rule("bearer", r"Bearer\x20+[A-Za-z0-9._~+/-]{16,}"),
)
RULES = BASE_RULES + MORE_RULES


def _trigrams(strings: set[str]) -> frozenset[frozenset[str]] | None:
    """The alternatives of which one must hold, each a set of trigrams that must all occur; None: no demand."""
    found = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in found else frozenset(x for x in found if not any(y < x for y in found))


def trigram_query(pattern: str) -> frozenset[frozenset[str]] | None:
    """A Boolean trigram query, as alternatives of trigram sets over lower-cased text, that every match of the pattern meets.

    The parts of a pattern that spell a small number of exact strings (literals, small classes, alternatives, optional
    parts) are strung together; what can't be spelt ends a run. The run with the fewest trigrams to miss, i.e. the one whose
    weakest alternative demands most, is the query. None: no trigram is mandatory, so the rule must scan all texts."""
    runs: list[frozenset[frozenset[str]]] = []

    def spell(nodes, strings: set[str]) -> set[str]:
        for op, arg in nodes:
            options = exact(op, arg)
            longer = {s + o for s in strings for o in options} if options is not None else set()
            if options is None or len(longer) > MOST_STRINGS:
                close(strings)
                if op is sre.SUBPATTERN and options is None:
                    strings = spell(arg[3], {""})
                elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                    close(spell(arg[2], {""}))
                    strings = {""}
                else:
                    strings = {""}
            else:
                strings = longer
        return strings

    def exact(op, arg) -> set[str] | None:
        """All strings that the node can match, or None if they are too many."""
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= SMALL_CLASS:
            return {chr(c).lower() for _, c in arg}
        if op is sre.SUBPATTERN:
            return exact_all(arg[3])
        if op is sre.BRANCH:
            parts = [exact_all(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 8:
            once = exact_all(arg[2])
            if once is None or len(once) ** arg[1] > MOST_STRINGS:
                return None
            found, power = set(), {""}
            for n in range(arg[1] + 1):
                found |= power if n >= arg[0] else set()
                power = {p + o for p in power for o in once}
            return found
        return {""} if op is sre.AT else None

    def exact_all(nodes) -> set[str] | None:
        strings = {""}
        for op, arg in nodes:
            options = exact(op, arg)
            strings = None if options is None else {s + o for s in strings for o in options}
            if strings is None or len(strings) > MOST_STRINGS:
                return None
        return strings

    def close(strings: set[str]) -> None:
        query = _trigrams(strings)
        if query is not None:
            runs.append(query)

    close(spell(sre_parser.parse(pattern), {""}))
    return max(runs, key=lambda q: (min(map(len, q)), -len(q)), default=None)


def rule_spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind>> of the rule's matches: code points, end exclusive.

    The text between matches gives the places: a match starts after all earlier pieces and matches."""
    pattern = F.lit(rule.regex())
    whole, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.regex(), -1)
    group = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    parts = F.arrays_zip(whole.alias("m"), F.slice(between, F.lit(1), F.size(whole)).alias("b"), group.alias("g"))
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int,kind:string>>)").alias("found"))

    def add(state: Column, x: Column) -> Column:
        at = state["at"] + F.length(x["b"])
        end = at + F.length(x["m"])
        span = F.array(F.struct(at.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= rule.least, F.concat(state["found"], span)).otherwise(state["found"]).alias("found"))

    return F.aggregate(parts, start, add, lambda state: state["found"])


def _found(text: Column, rule: Rule) -> Column:
    """rule_spans; a text without a match of the right length skips the split."""
    exact = rule.pattern.replace("+", "{%d,}" % rule.least) if rule.kind == "hex" else rule.regex()
    return F.when(F.regexp_like(text, F.lit(exact)), rule_spans(text, rule)).otherwise(F.expr("CAST(array() AS array<struct<start:int,end:int,kind:string>>)"))


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, content): for each of the trigrams the digests of the distinct texts whose lower-cased form holds it (trigrams are ASCII, so how other letters fold doesn't matter)."""
    low = docs.select("content", F.lower("text").alias("low"))
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]), lambda x: x.isNotNull())
    return low.select("content", F.explode(held).alias("trigram")).distinct()


def candidates(index: DataFrame, queries: dict[str, frozenset[frozenset[str]]]) -> DataFrame:
    """(content, kinds): the texts that meet each rule's Boolean query, by intersecting postings.

    The rules' alternatives are a literal relation, whose size is that of the rule set; a text meets one if as many of its trigrams
    have a posting there as it lists. Counts are summed before the exchange, so frequent trigrams are no hot keys."""
    terms = [(kind, n, len(alternative), t) for kind, query in sorted(queries.items()) for n, alternative in enumerate(sorted(map(sorted, query))) for t in alternative]
    relation = index.sparkSession.createDataFrame(terms, "kind string, alternative int, wanted int, trigram string")
    met = index.join(F.broadcast(relation), "trigram").groupBy("content", "kind", "alternative", "wanted").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.col("wanted"))
    return met.groupBy("content").agg(F.collect_set("kind").alias("kinds"))


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end by start, then kind in order of listing, comma-joined."""
    order = F.create_map(*[x for n, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(n))])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("place"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found (array<struct<start, end, kind>>, unordered) for each row of df.

    1. Each rule's regex gives a Boolean trigram query; an inverted index of just the trigrams that some query names is
       built over the distinct texts (by SHA-256, A-Z lower-cased). 2. Postings are intersected for each rule. 3. Candidates are
       verified by the rule's regex, once for each distinct text. Rules without mandatory trigrams scan every text in full.

    Ids may be null or repeat; a null text counts as empty and has no secrets; equal texts have equal results; empty df: no rows.

    Texts meet the candidates once: where these are few (broadcast_if_few) without being exchanged, else by digest and id. Everything
    else that travels is digests and spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    indexed, full = [r for r in rules if r.kind in queries], [r for r in rules if r.kind not in queries]
    nothing = F.expr("CAST(array() AS array<struct<start:int,end:int,kind:string>>)")
    scanned = docs.select("doc_id", "content", F.concat(nothing, *[_found(F.col("text"), r) for r in full]).alias("found"))
    if not indexed:
        return scanned.drop("content")
    index = stored(build_index(docs, sorted({t for q in queries.values() for a in q for t in a})), "secret-postings")
    wanted = stored(candidates(index, queries), "secret-candidates")
    # One copy of each candidate text, chosen on digests alone and joined by digest and id, so that copies of a text spread.
    chosen = stored(docs.groupBy("content").agg(F.min("doc_id").alias("chosen")).join(wanted, "content").withColumnRenamed("content", "wanted"), "secret-chosen")
    texts = docs.join(broadcast_if_few(chosen), (F.col("content") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("chosen"))).select("content", "kinds", "text")
    spans = [F.when(F.array_contains("kinds", r.kind), _found(F.col("text"), r)).otherwise(nothing) for r in indexed]
    verified = texts.select("content", F.concat(nothing, *spans).alias("more")).filter(F.size("more") > 0)
    verified = stored(verified.dropDuplicates(["content"]), "secret-verified")
    return scanned.join(broadcast_if_few(verified), "content", "left").select("doc_id", F.concat("found", F.coalesce("more", nothing)).alias("found"))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def secret_report(found: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and all spans as text, for each row of scan_secrets()."""
    kinds = [r.kind for r in base]
    own = F.filter("found", lambda x: x["kind"].isin(kinds))
    counts = [F.size(_of_kind(F.col("found"), k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(_listed(own, base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found"), rules).alias("spans"))
