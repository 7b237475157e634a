"""Information-theoretic sanitisation of personal data.

Base spans (email, ip, card, phone) are found by patterns.  Each different value is a protected entity c, and so are its telling parts
(mail domain and local name, network of an ip, issuer of a card, line of a phone), by which evidence on values of one text each
pools.  Over the corpus, p(c) and p(t) are the shares of documents that hold the entity and the term (a word of three letters or more, lower
case), and p(c, t) of those that hold the term within ``NEAR`` words of the entity.  A term discloses the share PMI(t; c) / IC(c) of what is
to be known about the entity, with PMI = log2 p(c | t) / p(c) and IC = -log2 p(c): 1 if the term always comes with it, 0 if independent.  For
p(c | t) stands the lower end of its confidence interval (Wilson's, one-sided, ``Z``), so that few texts count for less, by degrees,
and none for nothing.  In documents that hold the entity, terms with a share of at least ``generalise`` become their kind (<WORD>), and
those of at least ``remove`` go.

Each different text with entities counts once as evidence.  A mention meets at most 2 * ``NEAR`` words, so pairs grow with the length of a text, not with
its square.  They meet the document frequencies of all terms first: those whose share can't reach ``generalise`` however often they
come with the entity leave there, which is most; the others are counted by (entity, term).  Only documents with entities are dealt out to meet
their terms; all others pass through where they are read.

Edge cases: a null text is empty, without spans; repeated rows count as documents, but as one text; ids may be null or repeated;
very long texts, and long runs of letters or digits, take linear time; other columns, whatever their names, aren't read; an empty table gives
an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import frozen, numbered

GENERALISE = 0.8
REMOVE = 0.95
#: 95 % one-sided.
Z = 1.645
NEAR = 100
KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
DIGITS = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    """From each @ the local part reaches back as far as it can, not into the last match: linear, unlike a search from each letter."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind as listed in KINDS, then start; in code points."""
    out = list(_emails(text))
    if not DIGITS.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return out


def _key(kind: str, value: str) -> int:
    """Signed 64-bit number of an entity."""
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}") - 2**63


def protected(kind: str, value: str) -> Iterator[int]:
    """Numbers of an entity and its parts."""
    yield _key(kind, value)
    if kind == "email":
        local, _, domain = value.lower().rpartition("@")
        yield from (_key("local", local), _key("domain", domain))
    elif kind == "ip":
        octets = [str(int(x)) for x in value.split(".")]
        yield from (_key("network", ".".join(octets[:k])) for k in (2, 3))
    else:
        digits = "".join(DIGITS.findall(value))
        yield _key("issuer", digits[:6]) if kind == "card" else _key("line", digits[:-4])


def entities(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """(_row, text_hash, entities, terms, of, words) of ``docs`` (_row, text) with entities: the different ones and their parts, the different terms
    near any, for each of these the places in ``entities`` of those it is near, and the different terms of the whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row, text in zip(b["_row"], b["text"], strict=True):
                if not (spans := base_spans(text)):
                    continue
                numbers: dict[int, int] = {}
                of: dict[str, set[int]] = {}
                words = [(m.start(), m[0].lower()) for m in TERM.finditer(text)]
                for kind, start, end in spans:
                    own = [numbers.setdefault(x, len(numbers)) for x in protected(kind, text[start:end])]
                    for _, term in words[max(0, bisect_left(words, (start,)) - near) : bisect_left(words, (end,)) + near]:
                        of.setdefault(term, set()).update(own)
                h = xxhash.xxh3_64_intdigest(text) - 2**63
                rows.append((row, h, list(numbers), list(of), [sorted(x) for x in of.values()], list({w for _, w in words})))
            yield pd.DataFrame(rows, columns=["_row", "text_hash", "entities", "terms", "of", "words"])

    return docs.mapInPandas(run, "_row long, text_hash long, entities array<long>, terms array<string>, of array<array<int>>, words array<string>")


def term_frequencies(docs: DataFrame, most: int = 50_000) -> DataFrame:
    """(term, df) over all documents; each task sends partial counts of at most ``most`` terms at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                held.update({x.lower() for x in TERM.findall(text)})
                if len(held) > most:
                    yield pd.DataFrame(held.items(), columns=["term", "n"])
                    held.clear()
        if held:
            yield pd.DataFrame(held.items(), columns=["term", "n"])

    return docs.select("text").mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def lower_share(n: Column, df: Column, df_c: Column, texts: Column, total: int, z: float = Z) -> Column:
    """The share of an entity in ``df_c`` of ``total`` documents that a term in ``df`` documents discloses, ``n`` of which, in ``texts``
    different texts, hold both: with the lower end of the interval of n / df, on as many observations as are different."""
    p, m = n / df, df * texts / n
    low = (p + z * z / (2 * m) - z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    share = 1 + F.log2(low) / F.log2(F.lit(float(total)) / df_c)
    return F.when(df_c < total, share).otherwise(F.lit(0.0))


def disclosures(docs: DataFrame, generalise: float = GENERALISE, z: float = Z, near: int = NEAR) -> DataFrame:
    """(_row, term, share) of ``docs`` (_row, text): the terms to hide in each document, with the greatest share they disclose."""
    found = frozen(entities(docs, near), "entities")
    each = found.select("_row", F.posexplode("entities").alias("at", "entity"))
    known = frozen(each.groupBy("entity").agg(F.count("*").alias("df_c")), "known-entities")
    texts = found.groupBy("text_hash").agg(F.min("_row").alias("_row"), F.count("*").alias("copies"))
    texts = frozen(texts.select("_row", "copies"), "texts-with-entities")
    held = each.join(texts, "_row").join(known, "entity").groupBy("_row", "copies").agg(F.array_sort(F.collect_list(F.struct("at", "entity", "df_c"))).alias("held"))
    held = frozen(held, "entities-of-texts")
    total = docs.count()
    frequencies = frozen(term_frequencies(docs), "term-frequencies")
    words = found.select("_row", "terms", "of").join(held, "_row").select("copies", "held", F.explode(F.arrays_zip("terms", "of")).alias("w"))
    words = words.select("copies", F.col("w.terms").alias("term"), F.transform("w.of", lambda i: F.get("held", i)).alias("entities"))
    # no term discloses more than if it came with the entity wherever both can be: an exact bound
    most = F.least("df", F.col("entity.df_c"))
    rare = words.join(frequencies, "term").select("term", "df", "copies", F.explode("entities").alias("entity"))
    rare = rare.where(lower_share(most, F.col("df"), F.col("entity.df_c"), most, total, z) >= generalise)
    rare = frozen(rare.select("term", "df", "copies", "entity.entity", "entity.df_c"), "rare-terms")
    joint = rare.groupBy("entity", "term").agg(F.sum("copies").alias("n"), F.count("*").alias("texts"), F.first("df").alias("df"), F.first("df_c").alias("df_c"))
    share = lower_share(*map(F.col, ("n", "df", "df_c", "texts")), total, z)
    hidden = frozen(joint.select("entity", "term", share.alias("share")).where(F.col("share") >= generalise), "disclosing")
    # terms that occur meet what discloses by term: a document never meets its entities' other terms
    occurring = found.select("_row", F.explode("words").alias("term")).join(hidden, "term")
    return occurring.join(each.select("_row", "entity"), ["_row", "entity"]).groupBy("_row", "term").agg(F.max("share").alias("share"))


def _with_terms(text: str, spans: list[Span], terms: dict[str, float]) -> list[Span]:
    """``spans`` and those of the terms outside them; both are swept in the order of the text."""
    taken, out, i, reach = sorted((s, e) for _, s, e in spans), list(spans), 0, 0
    for m in TERM.finditer(text) if terms else ():
        while i < len(taken) and taken[i][0] < m.end():
            reach, i = max(reach, taken[i][1]), i + 1
        if reach <= m.start() and m[0].lower() in terms:
            out.append(("term", *m.span()))
    return out


def sanitise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", generalise: float = GENERALISE, remove: float = REMOVE, z: float = Z, near: int = NEAR) -> DataFrame:
    """doc_id, spans (array of kind, start, end), sanitised text."""
    kind = docs.select(doc_id).dtypes[0][1]
    # ids pass as strings: pandas would make floats of integers with nulls among them
    own = numbered(docs).select("_row", F.col("doc")[doc_id].cast("string").alias("doc_id"), F.coalesce(F.col("doc")[text], F.lit("")).alias("text"))
    hidden = disclosures(own.select("_row", "text"), generalise, z, near)
    hidden = frozen(hidden.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("terms")), "hidden")
    schema = "doc_id string, spans array<struct<kind: string, start: int, end: int>>, sanitised string"

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[not base_spans(t) for t in b["text"]]]
            if len(b):
                yield pd.DataFrame({"doc_id": b["doc_id"].array, "spans": [[] for _ in range(len(b))], "sanitised": b["text"].array})

    def telling(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[bool(base_spans(t)) for t in b["text"]]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for source, terms in zip(b["text"], b["terms"], strict=True):
                terms = dict(terms) if terms else {}
                spans = _with_terms(source, base_spans(source), terms)
                rows.append(([{"kind": k, "start": s, "end": e} for k, s, e in spans], _hide(source, spans, terms, remove)))
            yield pd.DataFrame(rows, columns=["spans", "sanitised"]).assign(doc_id=b["doc_id"].array)[["doc_id", "spans", "sanitised"]]

    both = own.mapInPandas(telling, "_row long, doc_id string, text string").join(hidden, "_row", "left").select("doc_id", "text", "terms")
    out = both.mapInPandas(run, schema).unionByName(own.mapInPandas(plain, schema))
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def _hide(text: str, spans: list[Span], terms: dict[str, float], remove: float) -> str:
    """Entities become their kind; terms become <WORD> or go.  Of spans that overlap, the first covers the rest."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < at:
            at = max(at, e)
            continue
        gone = kind == "term" and terms[text[s:e].lower()] >= remove
        out += [text[at:s], "" if gone else "<WORD>" if kind == "term" else f"<{kind.upper()}>"]
        at = e
    return "".join([*out, text[at:]])
