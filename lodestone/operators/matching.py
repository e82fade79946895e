"""All matches of a pattern with their offsets, clusters of matches, contexts."""

from __future__ import annotations

import functools
import re
from re import _parser as sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions.columns import ascii_bounds, let, stripped

MATCH = "array<struct<start:int,end:int,value:string>>"
RUN = 64


def all_matches(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, value>> (code points, ends exclusive): gaps and matches alternate, so lengths add up.

    Sums run within runs of matches, and over the runs, so that the time grows with the number of matches alone.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    values = F.regexp_extract_all(text, F.concat(F.lit("("), pattern, F.lit(")")), 1)
    steps = F.zip_with(values, F.split(text, pattern, -1), lambda v, g: F.struct(v.alias("value"), F.length(g).alias("gap"), F.length(v).alias("n")))
    return let(F.filter(steps, lambda x: x["value"].isNotNull()), _placed)


def _placed(steps: Column) -> Column:
    """Start and end of matches of which value, length (n) and distance from the one before (gap) are known."""
    width = lambda run: F.aggregate(run, F.lit(0), lambda a, x: a + x["gap"] + x["n"])
    starts = lambda runs: F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, r: F.struct((acc["at"] + width(r)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        return F.struct((a + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), (a + x["n"]).alias("end"), x["value"].alias("value")))).alias("out"))

    place = lambda run, at: F.aggregate(run, F.struct(at.alias("at"), F.array().cast(MATCH).alias("out")), step, lambda acc: acc["out"])
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(steps) - 1, F.lit(0)), F.lit(RUN)), lambda k: F.slice(steps, k + 1, F.lit(RUN)))
    return let(runs, lambda runs: F.flatten(F.zip_with(runs, starts(runs), place)))


def starts(pattern: str) -> list[str]:
    """Texts one of which any match starts with, three signs at least, if the pattern says so plainly; else none. Looked for
    as bytes, they keep most texts away from the pattern."""
    def of(items) -> tuple[list[str], bool]:
        head = ""
        for op, arg in items:
            if op is sre.LITERAL:
                head += chr(arg)
            elif op is sre.SUBPATTERN and not arg[1] and not arg[2]:
                more, whole = of(arg[3])
                if not whole:
                    return [head + m for m in more], False
                head += more[0]
            elif op is sre.BRANCH:
                return [head + m for b in arg[1] for m in of(b)[0]], False
            elif (op, arg) != (sre.AT, sre.AT_BOUNDARY):
                return [head], False
        return [head], True

    found = of(parsed(pattern))[0]
    return found if min(map(len, found)) >= 3 else []


def parsed(pattern: str):
    try:
        return sre.parse(pattern)
    except re.error:  # Java's own syntax: nothing is known of it
        return [(sre.ANY, None)]


def in_digit_words(pattern: str) -> bool:
    """Whether any match holds a digit and no white space, and depends on nothing beyond the white space around it: then
    it stands in ``digit_words`` too."""
    digits, spaces = set(map(ord, "0123456789")), set(map(ord, " \t\n\x0b\f\r"))

    def of(items) -> tuple[bool, bool]:
        """(holds a digit, holds no white space)"""
        digit, tight = False, True
        for op, arg in items:
            if op is sre.LITERAL:
                d, t = arg in digits, arg not in spaces
            elif op is sre.IN:
                inside = [one(*x) for x in arg if x[0] is not sre.NEGATE]
                negated = arg[0][0] is sre.NEGATE
                d, t = (False, (sre.CATEGORY, sre.CATEGORY_SPACE) in arg) if negated else (all(x[0] for x in inside), all(x[1] for x in inside))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
                d, t = of(arg[2])
                d = d and arg[0] > 0
            elif op is sre.SUBPATTERN:
                d, t = of(arg[3])
            elif op is sre.ATOMIC_GROUP:
                d, t = of(arg)
            elif op is sre.BRANCH:
                each = [of(b) for b in arg[1]]
                d, t = all(x[0] for x in each), all(x[1] for x in each)
            elif op in (sre.ASSERT, sre.ASSERT_NOT):
                d, t = False, of(arg[1])[1]
            else:
                d, t = False, (op, arg) == (sre.AT, sre.AT_BOUNDARY)
            digit, tight = digit or d, tight and t
        return digit, tight

    def one(op, arg) -> tuple[bool, bool]:
        if op is sre.LITERAL:
            return arg in digits, arg not in spaces
        if op is sre.RANGE:
            return ord("0") <= arg[0] and arg[1] <= ord("9"), not any(arg[0] <= s <= arg[1] for s in spaces)
        return arg is sre.CATEGORY_DIGIT, arg in (sre.CATEGORY_DIGIT, sre.CATEGORY_WORD, sre.CATEGORY_NOT_SPACE)

    return all(of(parsed(pattern)))


def digit_words(text: Column) -> Column:
    """array<struct<start, end, value>>: what stands between white space and holds a digit, a small part of most texts."""
    # signs one by one: Java looks such classes up in a table
    space = r"\t\n\x0b\f\r "
    pieces = F.regexp_extract_all(text, F.lit(rf"([^0123456789]*[{space}]|[^{space}]++)"), F.lit(1))
    word = lambda v: functools.reduce(lambda a, b: a & b, (~F.endswith(v, F.lit(c)) for c in " \n\t\r\x0b\f")) & v.rlike("[0123456789]")
    steps = F.transform(pieces, lambda v: F.struct(F.when(word(v), v).alias("value"), F.lit(0).alias("gap"), F.length(v).alias("n")))
    return let(steps, lambda x: F.filter(_placed(x), lambda w: w["value"].isNotNull()))


def _moved(found: Column, by: Column) -> Column:
    return F.transform(found, lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["value"].alias("value")))


def _joined(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["value"]), "\n")


def matches_in(words: Column, pattern: Column) -> Column:
    """``all_matches`` of a pattern that ``in_digit_words`` allows, from the words."""
    # a word that the pattern matches as a whole has no other match to be placed
    def found(w: Column) -> Column:
        first = F.regexp_substr(w["value"], pattern)
        return F.when(first.isNull(), F.array().cast(MATCH)).when(first == w["value"], F.array(w)).otherwise(_moved(all_matches(w["value"], pattern), w["start"]))

    return F.flatten(F.transform(words, found))


def has_match(pattern: str, text: str, words: str, low: str, words_low: str) -> Column:
    """Whether ``pattern`` has a match, by columns: the text, its ``digit_words`` a line each, and both in lower case."""
    few, ci = in_digit_words(pattern), pattern.startswith("(?i)")
    test, where = F.col(words if few else text).rlike(ascii_bounds(pattern)), F.col((words_low if few else low) if ci else words if few else text)
    begin = [F.contains(where, F.lit(s.lower() if ci else s)) for s in starts(pattern)]
    return functools.reduce(lambda a, b: a | b, begin) & test if begin else test


def mentions(docs: DataFrame, *, names=None, body="body", refs="refs", keep=("doc_id",), widen=1, contexts=False, near=True) -> DataFrame:
    """One row a match: ``keep``, pattern_name, priority, section, start, end, value, near, and with ``contexts`` also
    context (whole sentences around the match).

    Patterns for DOIs read their own section, all others the body and the references together. One cheap test a pattern,
    mostly over the words with a digit alone, keeps texts without it away from the scan. ``near`` tells whether a word of
    the pattern's database stands within its window (``widen`` times as wide); it is worked out while the text is at hand,
    so that no text is shuffled for it. Without ``near`` neither it nor the context is: ``surrounded`` adds them to those
    that are left.
    """
    section = lambda name: "body" if name in ("doi", "doi2") else "references" if name.startswith("doi_ref") else "all"
    of = {"body": "__body", "references": "__refs", "all": "__both"}
    texts = docs.select(*keep, F.col(body).alias("__body"), F.col(refs).alias("__refs"), F.concat(F.col(body), F.lit("\n"), F.col(refs)).alias("__both"))
    texts = texts.select("*", digit_words(F.col("__body")).alias("__body_d"), digit_words(F.col("__refs")).alias("__refs_d"), F.lower("__both").alias("__low"))
    texts = texts.select("*", F.concat("__body_d", _moved(F.col("__refs_d"), F.length("__body") + 1)).alias("__both_d"), _joined(F.col("__body_d")).alias("__body_w"), _joined(F.col("__refs_d")).alias("__refs_w"))
    texts = texts.select("*", F.concat("__body_w", F.lit("\n"), "__refs_w").alias("__both_w"))
    texts = texts.select("*", F.lower("__both_w").alias("__low_w"))
    tests = []
    for priority, (name, ci, pattern) in enumerate(rules.PATTERNS, 1):
        if names is None or name in names:
            pattern = f"(?i){pattern}" if ci else pattern
            rule = {"pattern_name": name, "priority": priority, "section": section(name), "__pattern": ascii_bounds(pattern), "__few": in_digit_words(pattern)}
            has = has_match(pattern, of[section(name)], f"{of[section(name)]}_w", "__low", "__low_w")
            tests.append(F.when(has, F.struct(*(F.lit(v).alias(k) for k, v in rule.items()))))
    # a row a pattern that the text has, then a row a match: what places the matches stands once in the plan, not once a pattern
    rows = texts.select(*keep, *of.values(), *(f"{c}_d" for c in of.values()), F.explode(F.array_compact(F.array(*tests))).alias("p"))
    own = lambda end: F.when(F.col("p.section") == "body", F.col(f"__body{end}")).when(F.col("p.section") == "references", F.col(f"__refs{end}")).otherwise(F.col(f"__both{end}"))
    rows = rows.select(*keep, own("").alias("__text"), F.when(F.col("p.__few"), own("_d")).alias("__words"), "p.*")
    found = F.when(F.col("__few"), matches_in(F.col("__words"), F.col("__pattern"))).otherwise(all_matches(F.col("__text"), F.col("__pattern")))
    if near:
        found = _with_surroundings(found, lambda m: F.col("__text"), lambda m: F.col("pattern_name"), widen, contexts, names)
    # exploded where it is worked out: the filter that Spark infers for an exploded column would work it out twice more
    return rows.select(*keep, "pattern_name", "priority", "section", F.explode(found).alias("m")).select(*keep, "pattern_name", "priority", "section", "m.*")


def _with_surroundings(found: Column, text, name, widen: int, contexts: bool, names=None) -> Column:
    """The structs of ``found`` with near and, if wanted, context; ``text`` and ``name`` of the pattern are given by struct."""
    by: dict[tuple[int, str], list[str]] = {}
    for n, _, _ in rules.PATTERNS:
        if (names is None or n in names) and (rule := rules.CONTEXT.get(database_of(n), (0, "")))[1]:
            by.setdefault(rule, []).append(n)

    def add(m: Column) -> Column:
        near = F.lit(True)
        for (window, words), of in by.items():
            left = F.greatest(m["start"] - window * widen, F.lit(0))
            here = F.substr(text(m), left + 1, m["end"] + window * widen - left)
            near = F.when(name(m).isin(*of), here.rlike(ascii_bounds(f"(?i){words}"))).otherwise(near)
        m_near = m.withField("near", near)
        return m_near.withField("context", sentence_context(text(m), m["start"], m["end"])) if contexts else m_near

    return F.transform(found, add)


def surrounded(found: DataFrame, docs: DataFrame, *, by="doc_id", body="body", refs="refs", widen=1, contexts=False) -> DataFrame:
    """``found`` (mentions without near) with near and, if wanted, context: its rows meet their texts once a document."""
    rest = [c for c in found.columns if c != by]
    lists = found.groupBy(by).agg(F.collect_list(F.struct(*rest)).alias("__found"))
    texts = docs.select(by, F.col(body).alias("__body"), F.col(refs).alias("__refs")).join(lists, by)
    texts = texts.withColumn("__both", F.concat("__body", F.lit("\n"), "__refs"))
    text = lambda m: F.when(m["section"] == "body", F.col("__body")).when(m["section"] == "references", F.col("__refs")).otherwise(F.col("__both"))
    d = texts.select(by, F.explode(_with_surroundings(F.col("__found"), text, lambda m: m["pattern_name"], widen, contexts)).alias("m"))
    return d.select(by, "m.*")


def database_of(name: str) -> str:
    return rules.DATABASE_OF.get(name, name.split("_")[0])


def first_by_priority(found: DataFrame, known: DataFrame, keys=("doc_id", "value")) -> DataFrame:
    """Recovery: matches whose keys are not known yet, each once, by the first pattern, then the first place."""
    w = W.partitionBy(*keys).orderBy("priority", "start")
    return found.join(known.select(*keys), list(keys), "left_anti").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def recovered(found: DataFrame, keys=("doc_id", "value")) -> DataFrame:
    """The same of one scan: matches with ``known`` (another pass has found them), keys of which none is known, each by
    the first pattern, then the first place."""
    g = found.groupBy(*keys).agg(F.bool_or("known").alias("__known"), F.min_by("pattern_name", F.struct("priority", "start")).alias("pattern_name"))
    return g.where("NOT __known").drop("__known")


def prefixed(docs: DataFrame, words=None, by="doc_id", text="text") -> DataFrame:
    """(by, prefix, start, end) of the words of repositories, by the prefix of their DOIs."""
    words = rules.REPOSITORY_WORDS if words is None else words
    has = F.array_compact(F.array(*(F.when(F.col(text).rlike(w), F.struct(F.lit(p).alias("prefix"), F.lit(w).alias("words"))) for p, w in words.items())))
    rows = docs.select(by, F.col(text).alias("__text"), F.explode(has).alias("p"))
    return rows.select(by, "p.prefix", F.explode(all_matches(F.col("__text"), F.col("p.words"))).alias("m")).select(by, "prefix", "m.start", "m.end")


def distinct_values(docs: DataFrame, patterns=None, by="doc_id", text="text") -> DataFrame:
    """(by, pattern_name, value): the different values that each pattern's first group has in a text."""
    patterns = rules.SIMPLE_PATTERNS if patterns is None else patterns
    d = docs.select(by, F.col(text).alias("__text"), _joined(digit_words(F.col(text))).alias("__w")).select("*", F.lower("__text").alias("__low"), F.lower("__w").alias("__low_w"))
    has = F.array_compact(F.array(*(F.when(has_match(p, "__text", "__w", "__low", "__low_w"), F.struct(F.lit(n).alias("name"), F.lit(ascii_bounds(p)).alias("pattern"))) for n, p in patterns.items())))
    rows = d.select(by, "__text", F.explode(has).alias("p"))
    return rows.select(by, F.col("p.name").alias("pattern_name"), F.explode(F.array_distinct(F.regexp_extract_all("__text", F.col("p.pattern"), 1))).alias("value"))


def clusters(found: DataFrame, docs: DataFrame, *, by="doc_id", text="text", gap=50, window=100) -> DataFrame:
    """Matches (by, prefix, start, end) less than ``gap`` apart form a cluster, named by its first match:
    (by, prefix, cluster_start, cluster_end, context). Texts of ``docs`` are joined once, to the clusters."""
    w = W.partitionBy(by).orderBy("start", "end", "prefix")
    apart = F.when(F.col("start") - F.lag("end").over(w) < gap, 0).otherwise(1)
    marked = found.withColumn("new", apart).withColumn("cluster", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = marked.groupBy(by, "cluster").agg(F.min_by("prefix", F.struct("start", "end", "prefix")).alias("prefix"), F.min("start").alias("cluster_start"), F.max_by("end", F.struct("start", "end")).alias("cluster_end"))
    out = out.join(docs.select(by, F.col(text).alias("__text")), by)
    left = F.greatest(F.col("cluster_start") - window, F.lit(0))
    context = F.trim(F.substr("__text", left + 1, F.col("cluster_end") + window - left))
    return out.select(by, "prefix", "cluster_start", "cluster_end", context.alias("context"))


def snippets(found: DataFrame, by="doc_id") -> DataFrame:
    """(by, registrant, snippet): the different contexts of an article's clusters of one prefix, in order, joined."""
    g = found.groupBy(by, "prefix").agg(F.array_sort(F.collect_list(F.struct("cluster_start", "context"))).alias("c"))
    return g.select(by, F.col("prefix").alias("registrant"), F.array_join(F.array_distinct(F.transform("c", lambda x: x["context"])), "").alias("snippet"))


def line_context(text: Column, start: Column, end: Column, before=200, after=100) -> Column:
    """The line around a match, clamped."""
    left = F.substr(text, F.greatest(start - before, F.lit(0)) + 1, F.least(start, F.lit(before)))
    right = F.substr(text, end + 1, F.lit(after))
    return F.concat(F.substring_index(left, "\n", -1), F.substr(text, start + 1, end - start), F.substring_index(right, "\n", 1))


#: Signs that end a sentence.
ENDS = r"[.!?\n。！？]"


def sentence_context(text: Column, start: Column, end: Column, before=200, after=100) -> Column:
    """Up to twice the wanted characters on each side, cut at the farthest sentence end in reach; once if there is none."""
    wide = lambda n: F.substr(text, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n)))
    left = F.when(wide(2 * before).rlike(ENDS), F.regexp_replace(wide(2 * before), rf"(?sU)^.*?{ENDS}\s*", "")).otherwise(wide(before))
    ahead = lambda n: F.substr(text, end + 1, F.lit(n))
    right = F.when(ahead(2 * after).rlike(ENDS), F.regexp_extract(ahead(2 * after), rf"(?s)^.*{ENDS}", 0)).otherwise(ahead(after))
    return stripped(F.concat(left, F.substr(text, start + 1, end - start), right))


def availability_header(text: Column, most: int = 500) -> Column:
    """What follows the first heading about the availability of data; null if there is none."""
    return let(F.regexp_instr(text, F.lit(rules.AVAILABILITY_HEADER)), lambda at: F.when(at > 0, stripped(F.substr(text, at, F.lit(most)))))


def availability_sentences(text: Column) -> Column:
    """array of sentences that say where data is: a word of availability and a repository at most 200 characters apart;
    long ones cut to 300 characters around both."""
    def snippet(s: Column) -> Column:
        one = lambda c, p: let(F.regexp_instr(c, F.lit(p)) - 1, lambda at: F.struct(at.alias("start"), (at + F.length(F.regexp_substr(c, F.lit(p)))).alias("end")))
        pair = F.struct(one(s, rules.AVAILABILITY_WORDS).alias("a"), one(s, rules.REPOSITORY_NAMES).alias("b"))
        return let(pair, lambda p: _snippet(s, p["a"], p["b"]))

    both = lambda s: s.rlike(rules.AVAILABILITY_WORDS) & s.rlike(rules.REPOSITORY_NAMES)
    # white space at the ends bears on neither word, and few sentences are left to be stripped
    some = F.filter(F.split(text, rules.SENTENCE_END), both)
    return F.array_compact(F.transform(some, lambda s: let(stripped(s), snippet)))


def _snippet(s: Column, a: Column, b: Column) -> Column:
    apart = F.when(a["start"] < b["start"], b["start"] - a["end"]).otherwise(a["start"] - b["end"])
    begin, end = F.least(a["start"], b["start"]), F.greatest(a["end"], b["end"])
    first = F.greatest(begin + F.floor((end - begin) / 2).cast("int") - 150, F.lit(0))

    def cut(first: Column) -> Column:
        last = F.least(first + 300, F.length(s))
        # from behind the next blank, or from the start if there is none
        blank = F.call_function("locate", F.lit(" "), s, first + 1)
        begin = F.when(first > 0, blank).otherwise(first)
        return let(begin, lambda at: F.concat(F.when(at > 0, "... ").otherwise(""), F.substr(s, at + 1, F.greatest(last - at, F.lit(0))), F.when(last < F.length(s), " ...").otherwise("")))

    return F.when(apart <= 200, F.when(F.length(s) > 300, let(first, cut)).otherwise(s))


def availability(text: Column) -> Column:
    """struct<statement, method>: what the header rule and the sentence rule find about the availability of data. Texts
    without the name of a repository are not cut into sentences."""
    some = text.rlike(rules.AVAILABILITY_WORDS) & text.rlike(rules.REPOSITORY_NAMES)
    found = F.when(some, let(F.array_join(availability_sentences(text), "\n"), lambda s: F.when(s != "", s)))

    def merged(f: Column) -> Column:
        header, search = f["header"], f["search"]
        method = F.when(search.isNotNull() & header.isNotNull(), "hybrid").when(header.isNotNull(), "header").when(search.isNotNull(), "sentence").otherwise("none")
        return F.struct(F.nullif(F.concat_ws("\n", search, header), F.lit("")).alias("statement"), method.alias("method"))

    return let(F.struct(availability_header(text).alias("header"), found.alias("search")), merged)
