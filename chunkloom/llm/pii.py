"""Personal data by fixed patterns and a skip-chain conditional random field.

Patterns find the certain cases (the base). The field adds to them: its nodes are a
document's mentions, which are the base spans and all other spans that could be personal
data written another way; its labels are the kinds and "none". Neighbouring mentions
share a potential (the chain), and so do mentions of the same or a similar token
however far apart (the skips), so loopy message passing carries the label of a certain
mention to its repetitions in a form that no pattern knows. Base spans are evidence
and stay as they are.

All weights are fitted together, by pseudo-likelihood, on a bounded sample of documents
whose base spans serve as labels. What a mention's looks say is hidden from half of the
mentions that have a skip link, so the links must learn to tell their labels; a loose
mention that repeats a certain one is not taken for "none" but left out. The links' prior
is that a token keeps its label when it returns, as repetitions may be rare in the sample.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm._common import table

KINDS = ("email", "ip", "card", "phone")
_NONE = len(KINDS)
#: Documents that the weights are trained on, about.
TRAIN_ROWS = 5000
#: A mention is added if its label is at least so probable.
SURE = 0.6
#: Digits that two numbers must share at the end to be similar.
ALIKE = 7
#: Digits of the longest certain number.
_LONGEST = 19
#: Prior log potential of a link whose ends have the same kind.
_RETURNS = 3.0
#: Messages that are worked out at once.
_AT_ONCE = 1 << 16

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE_NUMBER = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9])+")
_LOOSE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}[\x20]?(?:@|\(at\)|\[at\]|\x20at\x20)[\x20]?[A-Za-z0-9-]{1,63}(?:[\x20]?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)[\x20]?[A-Za-z0-9-]{1,63}){1,4}")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the certain cases, by kind and then start; linear in the text but for odd runs of digits and dots."""
    out: list[Span] = []
    at, after = text.find("@"), 0
    while at >= 0:
        # what stands before @, as far as it can be part of an address and is not part of the one before
        start = at
        while start > after and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            out.append((0, start, domain.end()))
            after = domain.end()
        at = text.find("@", max(at + 1, after))
    if not any(map(text.__contains__, "0123456789")):
        return out
    if text.count(".") > 2:
        for run in _DOTTED.finditer(text):
            if run[0].count(".") >= 3:
                for m in _IP.finditer(run[0]):
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                        out.append((1, run.start() + m.start(), run.start() + m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out.extend((3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15)
    return out


# ---------------------------------------------------------------- the field


def _key(piece: str, email: bool) -> str:
    """What two ways to write a mention have in common."""
    if email:
        plain = re.sub(r"[\s()\[\]]+", " ", piece.lower()).replace(" at ", "@").replace(" dot ", ".")
        return re.sub(r"[^a-z0-9@]+", "", plain)
    return _NOT_DIGIT.sub("", piece)


def mentions(text: str, base: list[Span]) -> list[tuple[int, int, int, str]]:
    """(start, end, label, key) in text order; label is ``_NONE`` for mentions that are not in the base."""
    taken = sorted((a, b) for _, a, b in base)
    found = [(a, b, k, _key(text[a:b], k == 0)) for k, a, b in base]
    free, last = [], 0
    for a, b in [*taken, (len(text), len(text))]:
        if a > last:
            free.append((last, a))
        last = max(last, b)
    for lo, hi in free:
        emails = [m.span() for m in _LOOSE_EMAIL.finditer(text, lo, hi)] if text.find("@", lo, hi) >= 0 or text.find("at", lo, hi) >= 0 else []
        found += [(a, b, _NONE, _key(text[a:b], True)) for a, b in emails]
        for m in _LOOSE_NUMBER.finditer(text, lo, hi):
            key = _key(m[0], False)
            if len(key) >= ALIKE and not any(a < m.end() and m.start() < b for a, b in emails):
                found.append((*m.span(), _NONE, key))
    return sorted(found)


#: What a mention looks like by itself.
_LOOKS = ("always", "at sign", "plus first", "bracket", "three dots", "hyphen", "space", "digits of a card", "digits of a phone", "checked card", "letter before", "letter behind")


def features(text: str, start: int, end: int, key: str) -> np.ndarray:
    """The answers to ``_LOOKS``, 1 or 0."""
    piece = text[start:end]
    digits = len(key) if key.isdigit() else 0
    return np.array(
        [
            1.0,
            "@" in piece,
            piece.startswith("+"),
            "(" in piece,
            piece.count(".") == 3,
            "-" in piece,
            " " in piece,
            16 <= digits <= 19,
            8 <= digits <= 15,
            16 <= digits <= 19 and luhn(key),
            start > 0 and text[start - 1].isalnum(),
            end < len(text) and text[end].isalnum(),
        ],
        float,
    )


def _compatible(key: str, known: dict[str, int], ends: dict[str, int]) -> list[int]:
    """Certain mentions whose key is the same, or a number of which one ends with the other's digits."""
    found = [known[key]] if key in known else []
    if key.isdigit():
        found += [known[key[-n:]] for n in range(ALIKE, min(len(key), _LONGEST + 1)) if key[-n:] in known]
        if len(key) >= ALIKE and key in ends:
            found.append(ends[key])
    return found


def skips(nodes: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """Links between mentions of the same or a similar token: to the last one, and to the nearest certain ones before and after.

    Linear in the mentions: certain ones are looked up by their key and its last digits.
    """
    out, last = set(), {}
    for k, (_, _, _, key) in enumerate(nodes):
        group = key[-ALIKE:] if key.isdigit() else key
        before = last.get(group)
        if before is not None and (key.endswith(nodes[before][3]) or nodes[before][3].endswith(key)):
            out.add((before, k))
        last[group] = k
    for order in (range(len(nodes)), range(len(nodes) - 1, -1, -1)):
        known: dict[str, int] = {}
        ends: dict[str, int] = {}
        for k in order:
            _, _, label, key = nodes[k]
            near = _compatible(key, known, ends)
            if near:
                other = min(near, key=lambda x: abs(x - k))
                out.add((min(k, other), max(k, other)))
            if label != _NONE:
                known[key] = k
                if key.isdigit():
                    ends |= {key[-n:]: k for n in range(ALIKE, len(key))}
    return sorted(out)


def _edges(n: int, links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Neighbours in the text that have no skip link."""
    linked = set(links)
    return [(k, k + 1) for k in range(n - 1) if (k, k + 1) not in linked]


#: What the pseudo-likelihood needs to know of a mention: looks, label, labels of its chain neighbours and of its skip-linked ones.
Term = tuple[tuple[float, ...], int, tuple[int, ...], tuple[int, ...]]


def terms(text: str) -> Iterator[Term]:
    """The terms of a document's mentions; see the module on what is hidden and left out."""
    nodes = mentions(text, base_spans(text))
    links = skips(nodes)
    linked = defaultdict(list)
    for a, b in links:
        linked[a].append(b)
        linked[b].append(a)
    label = [x[2] for x in nodes]
    unknown = [label[k] == _NONE and any(label[o] != _NONE for o in linked[k]) for k in range(len(nodes))]
    near = defaultdict(list)
    for a, b in _edges(len(nodes), links):
        near[a].append(b)
        near[b].append(a)

    def counted(others: list[int]) -> tuple[int, ...]:
        return tuple(sum(label[o] == kind and not unknown[o] for o in others) for kind in range(len(KINDS) + 1))

    for k, (a, b, own, key) in enumerate(nodes):
        if not unknown[k]:
            looks = tuple(features(text, a, b, key))
            by_links = counted(linked[k])
            yield (looks, own, counted(near[k]), by_links)
            if any(by_links):
                yield ((0.0,) * len(looks), own, counted(near[k]), by_links)


class Field:
    """Log potentials: of a mention by its looks, of neighbours' labels, of skip-linked labels."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def beliefs(self, looks: np.ndarray, labels: list[int], links: list[tuple[int, int]], rounds: int = 60) -> np.ndarray:
        """Probabilities of labels by loopy message passing until it settles; base labels are evidence."""
        n, size = len(labels), len(KINDS) + 1
        own = looks @ self.unary.T
        for k, label in enumerate(labels):
            if label != _NONE:
                own[k] = -50.0
                own[k, label] = 0.0
        chain = _edges(n, links)
        ends = np.array([*chain, *links], np.int64).reshape(-1, 2)
        if len(ends):
            src, dst = np.concatenate((ends, ends[:, ::-1])).T
            # both potentials are symmetric
            kind = np.tile(np.arange(len(ends)) >= len(chain), 2).astype(np.int64)
            pot = np.stack((self.chain, self.skip))
            back = np.concatenate((np.arange(len(ends)) + len(ends), np.arange(len(ends))))
            sent = np.zeros((len(src), size))
            for _ in range(rounds):
                total = own.copy()
                np.add.at(total, dst, sent)
                new = np.empty_like(sent)
                for at in range(0, len(src), _AT_ONCE):
                    some = slice(at, at + _AT_ONCE)
                    out = (total[src[some]] - sent[back[some]])[:, :, None] + pot[kind[some]]
                    top = out.max(1, keepdims=True)
                    new[some] = (top + np.log(np.exp(out - top).sum(1, keepdims=True)))[:, 0]
                new -= new.max(1, keepdims=True)
                moved = np.abs(new - sent).max()
                sent = 0.5 * sent + 0.5 * new
                if moved < 1e-6:
                    break
            np.add.at(own, dst, sent)
        own -= own.max(1, keepdims=True)
        chance = np.exp(own)
        return chance / chance.sum(1, keepdims=True)

    @staticmethod
    def trained(counted: dict[Term, float], rounds: int = 300) -> Field:
        """All weights by penalised pseudo-likelihood: the chance of each mention's label given its looks and its neighbours' labels."""
        size, width = len(KINDS) + 1, len(_LOOKS)
        unary, chain, skip = np.zeros((size, width)), np.zeros((size, size)), np.zeros((size, size))
        prior = np.eye(size) * _RETURNS
        prior[_NONE, _NONE] = 0.0
        skip += prior
        if counted:
            looks, label, near, linked = (np.array(x, float) for x in zip(*counted, strict=True))
            weight = np.array(list(counted.values()), float)
            truth = np.eye(size)[label.astype(int)] * (share := weight / weight.sum())[:, None]
            met = max(1e-9, (share[:, None] * linked).sum())
            for _ in range(rounds):
                score = looks @ unary.T + near @ chain + linked @ skip
                score -= score.max(1, keepdims=True)
                chance = np.exp(score)
                miss = truth - chance / chance.sum(1, keepdims=True) * share[:, None]
                unary += miss.T @ looks - 0.02 * unary
                step = miss.T @ near
                chain += 0.5 * (0.5 * (step + step.T) - 0.05 * chain)
                # links are rare: their gradient counts by what they see, so that the prior gives way as they are met
                step = miss.T @ linked / met
                skip += 0.2 * (0.5 * (step + step.T) - 0.05 * (skip - prior))
        unary[_NONE, 0] += 0.5
        return Field(unary, chain, skip)


def train(texts: DataFrame, train_rows: int = TRAIN_ROWS) -> Field:
    """The field from about train_rows rows of texts (id, text), chosen by a hash of the id.

    Every mention of the rows in the sample is learned from. Looks are twelve yes-or-no
    questions, so what comes to the driver is counts of few different terms.
    """
    n = texts.count()
    sample = texts.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000)) < F.lit(1_000_000 * train_rows / max(1, n))).where(F.col("text").rlike("[0-9@]"))
    size = len(KINDS) + 1

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[Term] = Counter()
            for text in batch.column(0):
                found.update(terms(text.as_py()))
            keys = [[*map(int, looks), label, *near, *linked] for looks, label, near, linked in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.int32())), pa.array(list(found.values()), pa.int64())], ["key", "n"])

    rows = sample.select("text").mapInArrow(learn, "key array<int>, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").collect()
    width = len(_LOOKS)
    return Field.trained({(tuple(map(float, k[:width])), k[width], tuple(k[width + 1 : width + 1 + size]), tuple(k[width + 1 + size :])): n for k, n in rows})


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Mentions outside the base whose label is sure once the document is taken together."""
    nodes = mentions(text, base)
    if all(label != _NONE for _, _, label, _ in nodes):
        return []
    links = skips(nodes)
    looks = np.array([features(text, a, b, key) for a, b, _, key in nodes])
    chance = field.beliefs(looks, [x[2] for x in nodes], links)
    best = chance.argmax(1)
    return [(int(best[k]), a, b) for k, (a, b, label, _) in enumerate(nodes) if label == _NONE and best[k] != _NONE and chance[k, best[k]] >= SURE]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, base, spans``, arrays of (kind, start, end) in order.

    Offsets count code points, end exclusive. spans are the base and what the field adds.
    Null texts count as empty and have no spans; repeated rows are answered each; an empty
    table gives an empty result; other columns are not read. A very long text is worked on
    whole, by one task.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    field = train(texts)
    kind = texts.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

        def told(spans: list[Span]) -> list[dict]:
            return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(spans)]

        for batch in batches:
            base, every = [], []
            for value in batch.column(1):  # one text at a time in Python's memory
                text = value.as_py()
                certain = base_spans(text)
                base.append(told(certain))
                every.append(told(certain + added_spans(text, certain, field)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(every, span)], ["id", "base", "spans"])

    spans = "array<struct<kind: string, start: int, end: int>>"
    return texts.mapInArrow(find, f"id {kind}, base {spans}, spans {spans}")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = personal_data(table(spark, sf_dir, "documents"))

    def joined(c: str):  # noqa: ANN202
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):  # noqa: ANN202
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("id").alias("doc_id"), *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_pii": op7_pii}
ORACLE_SQL: dict[str, str] = {}
