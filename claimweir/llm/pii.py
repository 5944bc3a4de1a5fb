"""Personal data: generators propose overlapping spans, boosted trees rate them, calibrated thresholds select."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweir.llm.boosting import BoostedTrees, add_trees, bin_edges, binned, calibrate, first_score, grow_trees, threshold
from claimweir.llm.shared import Scratch
from claimweir.llm.shingles import small_batches

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
SPAN = "struct<kind: string, start: long, end: long, chance: double>"
#: Bytes of text worked on at a time.
BATCH_BYTES = 4 << 20

# Possessive repeats and a start at the first digit of a number find what the plain patterns find, in time linear in the text.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def _local_start(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def luhn(digits: str) -> bool:
    back = [int(d) for d in reversed(digits)]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(back)) % 10 == 0


def _byte(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain forms, by start, then kind: leftmost, not overlapping within a kind, only those whose check holds."""
    out, done = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = _local_start(text, m.start(), done)
            if start < m.start():
                out.append((start, EMAIL, m.end()))
                done = m.end()
    if _DIGITS.search(text):
        out += [(m.start(), IP, m.end()) for m in _IP.finditer(text) if all(map(_byte, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), CARD, m.end()))
        out += [(m.start(), PHONE, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15]
    return sorted(out)


# --- candidates -----------------------------------------------------------------------------------------------------

#: Numbers in groups, parted by up to three signs.
_NUMBERS = re.compile(r"[0-9]++(?:[ ().\-/\[\]]{1,3}[0-9]++)*+")
#: At signs and what stands for them.
_AT = re.compile(r" ?(?:@|[\[({] ?(?:at|AT) ?[\])}]) ?| (?:at|AT) (?=[A-Za-z0-9-]{1,63}+ (?:dot|DOT) )")
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}+(?:(?: ?[\[({] ?(?:dot|DOT) ?[\])}] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]{1,63}+){1,10}")
_MOST_DIGITS = 19


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans that might be personal data, overlapping ones too."""
    out: set[tuple[int, int, int]] = set()
    for m in _AT.finditer(text):
        start = _local_start(text, m.start(), max(0, m.start() - 64))
        host = _HOST.match(text, m.end())
        if start < m.start() and host:
            out.add((start, EMAIL, host.end()))
    for m in _NUMBERS.finditer(text):
        groups = [(g.start(), g.end()) for g in _DIGITS.finditer(text, m.start(), m.end())]
        if sum(b - a for a, b in groups) < 4:
            continue
        for i, (start, _) in enumerate(groups):
            digits = 0
            for j in range(i, len(groups)):
                digits += groups[j][1] - groups[j][0]
                if digits > _MOST_DIGITS:
                    break
                end = groups[j][1]
                if j - i == 3 and all("." in text[groups[k][1] : groups[k + 1][0]] for k in range(i, j)):
                    out.add((start, IP, end))
                if digits >= 12:
                    out.add((start, CARD, end))
                if 7 <= digits <= 15:
                    out.add((start, PHONE, end))
                    for sign in ("+", "(", "+("):
                        if start >= len(sign) and text[start - len(sign) : start] == sign:
                            out.add((start - len(sign), PHONE, end))
    return sorted(out)


FEATURES = (
    "kind", "length", "digits", "groups", "longest group", "shortest group", "first group", "last group", "equal groups", "luhn", "bytes", "plus", "parentheses", "dots", "hyphens", "spaces", "slashes",
    "brackets", "letters", "local length", "labels", "last label", "last label letters", "leading zero", "digit before", "digit after", "sign before", "sign after", "letter before", "letter after", "quote before", "digits around", "distinct digits", "numbers around",
)


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format of a span and what stands around it, in the order of FEATURES."""
    span, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 24]
    parts = _DIGITS.findall(span)
    digits = "".join(parts)
    sizes = [len(p) for p in parts] or [0]
    at = _AT.search(span) if kind == EMAIL else None
    host = [x for x in re.split(r"[^A-Za-z0-9-]+", re.sub(r"\b(?:dot|DOT)\b", ".", span[at.end() :])) if x] if at else []
    left, right = before.rstrip(" ().-/[]")[-1:], after.lstrip(" ().-/[]")[:1]
    return [
        kind, end - start, len(digits), len(parts), max(sizes), min(sizes), sizes[0], sizes[-1], len(set(sizes)) == 1, bool(digits) and len(digits) <= _MOST_DIGITS and luhn(digits), bool(parts) and all(map(_byte, parts)),
        "+" in span, span.count("(") + span.count(")"), span.count("."), span.count("-"), span.count(" "), span.count("/"), span.count("[") + span.count("]"), sum(c.isalpha() for c in span), at.start() if at else 0,
        len(host), len(host[-1]) if host else 0, bool(host) and host[-1].isalpha(), digits[:1] == "0", left.isdigit(), right.isdigit(), before[-1:] == "+" or before[-1:] in (".", "-", "/"), after[:1] in ("-", "/") or after[:1] == "." and after[1:2].isdigit(),
        before[-1:].isalpha(), after[:1].isalpha(), before[-1:] in ('"', "'", "="), sum(c.isdigit() for c in before + after), len(set(digits)), len(_DIGITS.findall(before)) + len(_DIGITS.findall(after)),
    ]


# --- examples -------------------------------------------------------------------------------------------------------

#: Signs of text on either side of a span that an example is made with, and examples made of each span.
_AROUND = 40
REWRITTEN = 4


def _group_digits(digits: str, sizes: list[int], sign: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return sign.join(p for p in [*out, digits[at:]] if p)


def rewritten(kind: int, span: str, draw: int) -> tuple[str, bool]:
    """Another way to write a span of a plain form, or (False) something like it that is none."""
    digits = "".join(_DIGITS.findall(span))
    if kind == EMAIL:
        local, host = span.rsplit("@", 1)
        short = host.split(".", 1)[1]
        local = [local, local.replace(".", "_"), re.split(r"[._%+-]", local)[0] or local, f"{local[0]}.{local}"][draw % 4]
        host = short if "." in short and draw % 5 < 2 else host
        forms = [f"{local} @ {host}", f"{local}[at]{host}", f"{local} (at) {host}", f"{local} at {host.replace('.', ' dot ')}", f"{local} [at] {host.replace('.', ' [dot] ')}", f"{local}@{host.replace('.', '(dot)')}"]
        wrong = [f"{local} @ {host.split('.')[0]}.{draw % 97}", f"{local}[at]{draw % 10}.{draw % 10}", f"{local}@{draw % 100}.{draw % 7}"]
    elif kind == IP:
        parts = span.split(".")
        forms = ["[.]".join(parts), " . ".join(parts), "(.)".join(parts), ". ".join(parts)]
        far = [*parts[:2], str(256 + draw % 700), parts[3]]
        wrong = ["[.]".join(far), " . ".join(far), ".".join([*parts, str(draw % 256)]), ".".join(far)]
    elif kind == CARD:
        odd = digits[:-1] + str((int(digits[-1]) + 1 + draw % 9) % 10)
        forms = [_group_digits(digits, [4] * 4, s) for s in (".", "/", "  ", " - ")]
        wrong = [odd, *(_group_digits(odd, [4] * 4, s) for s in (" ", "-", ".", "/"))]
    else:
        own = digits[-10:]
        digits = str(draw % 9 + 1) * (draw % 2 and len(digits) < 13) + digits  # longer country codes too
        forms = [f"({own[:3]}) {own[3:6]}-{own[6:]}", _group_digits(own, [3, 3], "-"), _group_digits(own, [3, 3], "."), _group_digits(own, [3, 3], " "), "00" + _group_digits(digits, [len(digits) - 10 or 1, 3, 3], " "), "+" + _group_digits(digits, [len(digits) - 10 or 1, 3, 3], "/")]
        wrong = [own, _group_digits(own, [5], "."), _group_digits(digits + own, [4, 5, 3, 2], " "), f"{own[:4]}-{own[4:6]}-{own[6:8]}", _group_digits(own, [1, 2], " / ")]
    right = draw % 3 > 0
    some = forms if right else wrong
    return some[draw // 3 % len(some)], right


def examples(text: str) -> list[tuple[int, list[float], int]]:
    """(mark, features, label) of a text's candidates: right ones are its plain forms, and rewritten forms put in their place."""
    base = base_spans(text)
    known = set(base)
    out = []

    def add(where: str, span: tuple[int, int, int], label: int, salt: int) -> None:
        start, kind, end = span
        near = where[max(0, start - _AROUND) : end + _AROUND].encode("utf-8", "surrogatepass")
        out.append((zlib.crc32(near + bytes([kind, salt])), [float(v) for v in features(where, *span)], label))

    for span in candidates(text):
        add(text, span, int(span in known), 0)
    for start, kind, end in base:
        before, after = text[max(0, start - _AROUND) : start], text[end : end + _AROUND]
        for salt in range(1, REWRITTEN + 1):
            draw = zlib.crc32((before + text[start:end] + after).encode("utf-8", "surrogatepass") + bytes([salt]))
            form, right = rewritten(kind, text[start:end], draw)
            where, put = before + form + after, (len(before), kind, len(before) + len(form))
            plain = set(base_spans(where))
            for span in candidates(where):
                if span[0] < put[2] and put[0] < span[2] and span not in plain:
                    add(where, span, int(right and span == put), salt)
    return out


@dataclass(frozen=True)
class Recogniser:
    """Rates candidates; `cuts` is the chance from which on a span of each kind is selected. Without trees only plain forms are found."""

    trees: BoostedTrees | None
    cuts: tuple[float, ...] = (1.01,) * 4

    def find(self, text: str) -> list[tuple[int, int, int, float | None]]:
        """(start, kind, end, chance) of the plain forms (without a chance) and of selected candidates that overlap none of them, nor
        a likelier one, by start, then kind."""
        base = base_spans(text)
        out: list[tuple[int, int, int, float | None]] = [(*s, None) for s in base]
        spans = [] if self.trees is None else candidates(text)
        for low in range(0, len(spans), 10_000):
            part = spans[low : low + 10_000]
            chance = self.trees.chance(np.array([features(text, *s) for s in part], float))
            out += [(*s, float(p)) for s, p in zip(part, chance, strict=True) if p >= self.cuts[s[1]]]
        if len(out) == len(base):
            return out
        kept: list[tuple[int, int, int, float | None]] = out[: len(base)]
        taken = _Taken([(s, e) for s, _, e in base])
        for s in sorted(out[len(base) :], key=lambda s: (-s[3], s[0] - s[2], s)):
            if taken.free(s[0], s[2]):
                taken.add(s[0], s[2])
                kept.append(s)
        return sorted(kept, key=lambda s: s[:3])


class _Taken:
    """Stretches of a text in blocks of 64 places, so that a look-up meets only its neighbours."""

    def __init__(self, stretches: list[tuple[int, int]]):
        self.blocks: dict[int, list[tuple[int, int]]] = {}
        for s in stretches:
            self.add(*s)

    def add(self, start: int, end: int) -> None:
        for block in range(start >> 6, (end - 1 >> 6) + 1):
            self.blocks.setdefault(block, []).append((start, end))

    def free(self, start: int, end: int) -> bool:
        return not any(s < end and start < e for block in range(start >> 6, (end - 1 >> 6) + 1) for s, e in self.blocks.get(block, ()))


#: Features are whole numbers from 0; greater ones than this count as this in training.
_MOST = 1023
#: Scores of held-out examples are counted in cells, so many to 1, from -_REACH to _REACH.
_CELLS, _REACH = 256, 20


def _blobs(texts: list[str | None]) -> list[tuple[bytes, bytes, bytes]]:
    """Of each text, its examples: features as 16-bit numbers, labels, and whether they are held out."""
    out = []
    for text in texts:
        found = examples(text) if text else []
        x = np.minimum(np.array([e[1] for e in found], float).reshape(-1, len(FEATURES)), _MOST).astype(np.uint16)
        out.append((x.tobytes(), bytes(e[2] for e in found), bytes(e[0] % 4 == 0 for e in found)))
    return out


def _joined(batch: pa.RecordBatch, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind)


def _sums(rows: DataFrame, part) -> np.ndarray:
    """The sum of the arrays that `part` makes of the batches of a table; empty for an empty table."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(float).tobytes()], pa.binary())], names=["sums"])

    found = [np.frombuffer(r["sums"]) for r in rows.mapInArrow(run, "sums binary").collect()]
    return np.sum(found, 0) if found else np.zeros(0)


def train_recogniser(docs: DataFrame, precision: float = 0.99, text_column: str = "text") -> Recogniser:
    """Trees learned from the plain forms of a corpus, from rewritten ones and from what looks alike but fails the checks.

    All distinct texts that hold a digit or an at sign give examples: about three quarters to fit the trees, the rest to calibrate chances
    and to choose the least cut of each kind at which `precision` of the selected are right. Examples are written once, equal ones of a
    block as one with their number; each level of a tree is a pass over them, of which the driver gets sums of a fixed size a task. Scores
    of held-out examples are counted in cells. A corpus without right and wrong examples gives a recogniser of plain forms only.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    try:
        return _train(docs, precision, text_column, scratch)
    finally:
        scratch.clear()


def _train(docs: DataFrame, precision: float, text_column: str, scratch: Scratch) -> Recogniser:
    told = docs.select(F.col(text_column).cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]"))
    width = len(FEATURES)

    def find(batches):
        for batch in small_batches(batches, 1, BATCH_BYTES):
            x, y, held = zip(*_blobs(batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.binary()) for v in (x, y, held))], names=["hash", "x", "y", "held"])

    found = told.select(F.xxhash64("text").alias("hash"), "text").mapInArrow(find, "hash long, x binary, y binary, held binary")
    found = scratch.write(found.filter(F.octet_length("y") > 0).dropDuplicates(["hash"]).drop("hash"))

    def numbers(batch):
        """Of fitted examples, how often each feature has each value; of all, how many are wrong and right, fitted and held out."""
        x, y, held = _joined(batch, "x", np.uint16).reshape(-1, width), _joined(batch, "y", np.uint8), _joined(batch, "held", np.uint8)
        values = [np.bincount(column, minlength=_MOST + 1) for column in x[held == 0].T]
        return np.concatenate([np.bincount(2 * held + y, minlength=4), *values])

    sums = _sums(found, numbers)
    if not len(sums) or not sums[:4].all():
        return Recogniser(None)
    edges = bin_edges(sums[4:].reshape(width, -1))
    base = first_score(sums[1], sums[0] + sums[1])
    names = ["x", "weight", "score"]

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                x = _joined(batch, "x", np.uint16).reshape(-1, width)
                # label, held out and kind stand beside the bins
                rows = np.ascontiguousarray(np.c_[binned(x, edges), _joined(batch, "y", np.uint8), _joined(batch, "held", np.uint8), x[:, 0].astype(np.uint8)])
                keys, weight = np.unique(rows.view(np.dtype((np.void, rows.shape[1]))).ravel(), return_counts=True)
                blobs = (keys.tobytes(), weight.astype(float).tobytes(), np.full(len(keys), base).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs], names=names)

    blocks = [scratch.write(found.mapInArrow(pack, "x binary, weight binary, score binary"))]
    scratch.drop(found)

    def parts(batch):
        return _joined(batch, "x", np.uint8).reshape(-1, width + 3), _joined(batch, "weight", float), _joined(batch, "score", float)

    def over(part):
        def fitted(batch):
            rows, weight, score = parts(batch)
            own = rows[:, width + 1] == 0
            return part(rows[own, :width], rows[own, width], weight[own], score[own])

        return _sums(blocks[-1], fitted)

    def keep(trees):
        def scored(batches):
            for batch in batches:
                if batch.num_rows:
                    rows, weight, score = parts(batch)
                    blobs = (rows.tobytes(), weight.tobytes(), add_trees(rows[:, :width], score, trees).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs], names=names)

        blocks.append(scratch.write(blocks[-1].mapInArrow(scored, "x binary, weight binary, score binary")))
        scratch.drop(blocks[-2])

    trees, grown = grow_trees(over, keep, edges, base)
    cells = 2 * _REACH * _CELLS + 1

    def held_out(batch):
        rows, weight, _ = parts(batch)
        own = rows[:, width + 1] == 1
        rows, weight = rows[own], weight[own]
        score = add_trees(rows[:, :width], np.full(len(rows), base), grown)
        cell = np.round((np.clip(score, -_REACH, _REACH) + _REACH) * _CELLS).astype(np.int64)
        return np.bincount((rows[:, width + 2].astype(np.int64) * 2 + rows[:, width]) * cells + cell, weight, 8 * cells)

    counts = _sums(blocks[-1], held_out).reshape(4, 2, cells)
    kind, y, cell = np.nonzero(counts)
    weight, z, y = counts[kind, y, cell], cell / _CELLS - _REACH, y.astype(float)
    trees = calibrate(trees, z, y, weight)
    chance = 1 / (1 + np.exp(-(trees.slope * z + trees.offset)))
    return Recogniser(trees, tuple(threshold(chance[kind == k], y[kind == k], precision, weight=weight[kind == k]) for k in range(4)))


def find_personal_data(docs: DataFrame, model: Recogniser, redacted: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The personal data of each whole text.

    Returns one row per row: id and spans (array of kind, start, end, chance, in code points, end exclusive, by start, then kind as in
    KINDS). Plain forms whose checks hold are always among them, with a null chance; the others were selected by the model and overlap no
    other span. With `redacted`, also the text with each span replaced by its kind in brackets (of overlapping ones, the first).

    Null and empty texts have no spans (a null text stays null when redacted). Repeated rows are answered each, null ids are passed
    on, other columns are ignored, an empty table gives an empty result. Texts are searched within their tasks, in time linear in
    the text, without a shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # trees of a fixed size

    def find(batches):
        for batch in small_batches(batches, 1, BATCH_BYTES):
            texts = batch.column(1).to_pylist()
            found = [sent.value.find(t) if t else [] for t in texts]
            bounds = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = [s for own in found for s in own]
            columns = [pa.array([KINDS[s[1]] for s in flat], pa.string()), *(pa.array([s[i] for s in flat], pa.int64()) for i in (0, 2)), pa.array([s[3] for s in flat], pa.float64())]
            spans = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(columns, names=["kind", "start", "end", "chance"]))
            more = [pa.array([t and _redact(t, own) for t, own in zip(texts, found, strict=True)], pa.string())] if redacted else []
            yield pa.RecordBatch.from_arrays([batch.column(0), spans, *more], names=["id", "spans", "redacted"][: 2 + redacted])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(find, f"id {kind}, spans array<{SPAN}>" + ", redacted string" * redacted).withColumnRenamed("id", id_column)


def _redact(text: str, spans: list[tuple[int, int, int, float | None]]) -> str:
    out, at = [], 0
    for start, kind, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
