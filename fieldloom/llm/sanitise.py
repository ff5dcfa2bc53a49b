"""Personal data: patterns find protected entities, information theory finds the terms that give them away.

A term t discloses an entity e by PMI(e; t) / IC(e): the share of what it takes to name e (its information
content, -log p(e)) that a reader of t already has. It is 1 where t never occurs but in company of e. The
probabilities are counts over all documents; company is a window of terms around an occurrence of e. Copies
of one passage are one piece of evidence: `support` different windows must hold the two, and e's windows must
differ: of the terms of one of them at most a share of ALIKE, on average, may be found in another one. Where
more recur, the company tells of a passage that is copied with small changes, not of the entity.

1. One map over whole texts finds the entities and writes counts: documents of each term and of each
   entity, and the windows of each pair. Grouping and joins give each term's largest disclosure.
2. A second map marks the entities and, wherever they stand, the terms above the thresholds; the worst
   are removed, the others generalised to the class of their shape.

Entities are known by 128-bit hashes in all that is written.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import arrow_map, discard, ready, written

BASE = ("email", "ip", "card", "phone")
#: All kinds of spans, in the order in which those of equal start are listed.
KINDS = (*BASE, "generalised", "removed")
#: Terms on each side of an entity that count as its company.
WINDOW = 10
#: Different windows in which a term and an entity must be met.
SUPPORT = 3
#: Share of a window's terms that an entity's other windows may have too, on average.
ALIKE = 0.5
#: Disclosure from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Terms of which a task holds counts before it hands them on.
HELD = 300_000
#: Disclosing terms that travel with the tasks at a time; more are further passes over the texts.
BLOCK_TERMS = 500_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_NO_DIGIT = re.compile("[^0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain; each character is looked at a bounded number of times."""
    done, at = 0, text.find("@")
    while at >= 0:
        following = at + 1
        if m := _DOMAIN.match(text, at + 1):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = following = m.end()
        at = text.find("@", following)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Runs of digits joined by dots, four at a time."""
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        start = m.start()
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                yield start, start + size
            start += size + 1


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def entities(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, by start and kind."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    found += [(a, 1, b) for a, b in addresses(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NO_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m.group())) <= 15]
    found.sort()
    return found


def entity_key(kind: int, value: str) -> bytes:
    """An entity's hash: addresses of any case, cards and phones of any spacing are one."""
    plain = value.translate(_LOWER) if kind < 2 else _NO_DIGIT.sub("", value)
    return hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=16).digest()


def covered(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The union of (start, kind, end) spans in order; overlapping ones become one of the first's kind."""
    out: list[tuple[int, int, int]] = []
    for start, kind, end in spans:
        if out and start < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(end, out[-1][2]))
        else:
            out.append((start, kind, end))
    return out


def outside(matches: Iterator[re.Match], spans: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Matches, in order, that touch none of the disjoint ordered spans."""
    at = 0
    for m in matches:
        while at < len(spans) and spans[at][2] <= m.start():
            at += 1
        if at == len(spans) or spans[at][0] >= m.end():
            yield m


def company(text: str, spans: list[tuple[int, int, int]], window: int) -> Iterator[tuple[bytes, list[str], int]]:
    """(entity, the terms around it, hash of that window) for each entity of a text. Terms inside entities don't count."""
    places = list(outside(_TERM.finditer(text), covered(spans)))
    terms = [m.group().translate(_LOWER) for m in places]
    at = 0
    for start, kind, end in spans:
        while at < len(places) and places[at].start() < start:
            at += 1
        near = terms[max(0, at - window) : at + window]
        yield entity_key(kind, text[start:end]), near, int.from_bytes(hashlib.blake2b(" ".join(near).encode(), digest_size=8).digest(), "big", signed=True)


def _counts(docs: DataFrame, window: int, text_col: str) -> DataFrame:
    """(entity, term, place, n): term alone, how many documents hold it; entity alone, likewise; both, the
    documents and the window they meet in. A task adds up what it can before it hands rows on."""
    held = HELD

    def make():
        class Adding:
            def __init__(self):
                self.terms, self.entities, self.pairs = Counter(), Counter(), Counter()

            def __call__(self, batch: pa.RecordBatch):
                for text in batch.column(0).to_pylist():
                    if not text:
                        continue
                    self.terms.update(set(_TERM.findall(text.translate(_LOWER))))
                    if spans := entities(text):
                        met, alone = {}, set()
                        for entity, near, place in company(text, spans, window):
                            alone.add(entity)
                            for t in near:
                                met.setdefault((entity, t), set()).add(place)
                        self.entities.update(alone)
                        for (entity, t), places in met.items():
                            for i, place in enumerate(sorted(places)):
                                self.pairs[entity, t, place] += not i  # one document, however many windows
                    if len(self.terms) + len(self.entities) + len(self.pairs) >= held:
                        yield from self.finish()

            def finish(self):
                rows = [(None, t, None, n) for t, n in self.terms.items()] + [(e, None, None, n) for e, n in self.entities.items()] + [(*k, n) for k, n in self.pairs.items()]
                self.__init__()
                for i in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 20_000]), (pa.binary(), pa.string(), pa.int64(), pa.int64()))], names=["entity", "term", "place", "n"])

        return Adding()

    return arrow_map(docs.select(text_col), make, "entity binary, term string, place bigint, n bigint")


def disclosing_terms(docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, alike: float = ALIKE, threshold: float = GENERALISE, text_col: str = "text") -> DataFrame:
    """(term, disclosure): terms whose PMI with some entity is at least `threshold` of that entity's information content.

    Counted over the whole texts of all documents; the rows' ids don't matter. Repeated rows and copies count
    as documents, but their windows are one piece of evidence. Null and empty texts are documents without
    terms; an empty table discloses nothing. A written table, small beside the texts.
    """
    counts = written(_counts(docs, window, text_col), "counts")
    total = F.lit(docs.count())
    terms = counts.where("entity is null").groupBy("term").agg(F.sum("n").alias("n_term"))
    alone = counts.where("term is null").groupBy("entity").agg(F.sum("n").alias("n_entity"))
    met = counts.where("entity is not null and term is not null").groupBy("entity", "term", "place").agg(F.sum("n").alias("n"))
    pairs = met.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("windows"))
    # a term drawn from one window is in windows / all of the entity's windows
    every = met.groupBy("entity", "place").agg(F.count("*").alias("size")).groupBy("entity").agg(F.count("*").alias("places"), F.sum("size").alias("size"))
    recurring = pairs.groupBy("entity").agg(F.sum(F.col("windows").cast("double") * F.col("windows")).alias("square")).join(every, "entity")
    varied = recurring.where(F.col("square") <= F.lit(alike) * F.col("places") * F.col("size")).select("entity")
    pairs = pairs.where(F.col("windows") >= support).join(varied, "entity")
    content = F.log(total / F.col("n_entity"))
    # PMI(e; t) = log(N n_both / (n_entity n_term)) = IC(e) + log(n_both / n_term)
    disclosure = 1 + F.log(F.col("n_both") / F.col("n_term")) / content
    scored = pairs.join(alone, "entity").where(F.col("n_entity") < total).join(terms, "term").withColumn("disclosure", disclosure)
    out = written(scored.where(F.col("disclosure") >= threshold).groupBy("term").agg(F.max("disclosure").alias("disclosure")), "disclosing")
    discard(counts)
    return out


def _blocks(risk: DataFrame) -> Iterator[dict[str, float]]:
    block: dict[str, float] = {}
    for row in risk.toLocalIterator():
        block[row["term"]] = row["disclosure"]
        if len(block) >= BLOCK_TERMS:
            yield block
            block = {}
    yield block  # the last, perhaps empty


def shape(term: str) -> str:
    """The class a term is generalised to."""
    if term.isdigit():
        return "[NUMBER]"
    if any(c.isdigit() for c in term):
        return "[CODE]"
    return "[NAME]" if term[0].isupper() else "[WORD]"


def sanitised(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with entities by their kind's name, generalised terms by their class, removed ones gone."""
    out, at = [], 0
    for start, kind, end in covered(spans):
        out.append(text[at:start])
        if kind < len(BASE):
            out.append(f"[{BASE[kind].upper()}]")
        elif KINDS[kind] == "generalised":
            out.append(shape(text[start:end]))
        at = end
    return "".join(out) + text[at:]


_SPANS = "array<struct<start:int,kind:int,end:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def _marked(df: DataFrame, risk: dict[str, float], remove: float, last: bool) -> DataFrame:
    """df (doc_id, text, spans) with the block's terms added to spans; the last block's pass also finds the
    entities, drops terms that touch one and adds the sanitised text."""

    def make():
        def terms(text: str) -> list[tuple[int, int, int]]:
            if not risk or risk.keys().isdisjoint(_TERM.findall(text.translate(_LOWER))):
                return []
            return [(m.start(), KINDS.index("removed" if d >= remove else "generalised"), m.end()) for m in _TERM.finditer(text) if (d := risk.get(m.group().translate(_LOWER))) is not None]

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, before = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            spans, clean = [], []
            for text, old in zip(texts, before):
                text = text or ""
                found = sorted([(s["start"], s["kind"], s["end"]) for s in old or ()] + terms(text))
                if last:
                    base = entities(text)
                    if base and found:
                        whole, at, free = covered(base), 0, []
                        for span in found:
                            while at < len(whole) and whole[at][2] <= span[0]:
                                at += 1
                            if at == len(whole) or whole[at][0] >= span[2]:
                                free.append(span)
                        found = free
                    found = sorted(base + found)
                    clean.append(sanitised(text, found) if found else text)
                spans.append([{"start": a, "kind": k, "end": b} for a, k, b in found])
            columns = [batch.column(0), batch.column(1), pa.array(spans, _SPAN)] + ([pa.array(clean, pa.string())] if last else [])
            if last:
                columns.pop(1)
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "spans", "sanitised"] if last else ["doc_id", "text", "spans"])

        return one

    id_type = df.schema["doc_id"].dataType.simpleString()
    return arrow_map(df, make, f"doc_id {id_type}, spans {_SPANS}, sanitised string" if last else f"doc_id {id_type}, text string, spans {_SPANS}")


def sanitise(docs: DataFrame, risk: DataFrame | None = None, remove: float = REMOVE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, sanitised) for each row: where personal data and disclosing terms stand (start, kind as a
    place in KINDS, end; code points, end exclusive; by start and kind), and the text without them.

    risk: (term, disclosure), by default `disclosing_terms` of these documents. Entities of different kinds may
    overlap; terms that touch an entity are not marked. Null texts are empty, null ids stay null, repeated rows
    stay, an empty table gives no rows; other columns aren't read. One map; with over BLOCK_TERMS disclosing
    terms one for each block of them, written in between.
    """
    ready(docs.sparkSession)
    if risk is None:
        risk = disclosing_terms(docs, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).cast(_SPANS).alias("spans"))
    blocks = _blocks(risk)
    block = next(blocks)
    for following in blocks:
        if following:
            before, rows = rows, written(_marked(rows, block, remove, last=False), "marked")
            discard(before)
            block = following
    return _marked(rows, block, remove, last=True)


def digests(found: DataFrame) -> DataFrame:
    """sanitise's rows as counts of each base kind, a digest of the base spans, and all spans as a string."""

    def text(spans):
        kinds = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == F.lit(at))).cast("bigint").alias(f"n_{kind}") for at, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
