"""Personal data: exact patterns, and a linear-chain CRF over word shapes that adds to them.

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers. The CRF
finds what they miss: spelled-out e-mail addresses, addresses and numbers with blanks or dots
between their parts, phone numbers without a plus, numbers that a pattern joined to others. It
tags each word with a kind or none. A word is described by its shape (runs of capitals, small
letters, digits and marks), how many digits and characters it has, the coarse class of its
neighbours, and whether it or a neighbour is one of a few cue words. It learns from a small
labelled table, `SENTENCES` sentences made by rule, by maximum likelihood with a ridge
(forward-backward in numpy), and decodes whole texts by Viterbi in numpy batches. Words whose
own evidence for "none" outweighs anything that transitions could add are settled beforehand,
which is exact, so that only what lies between them is decoded. Neighbouring words of a kind
make spans, if the path beats the path of no data by `MARGIN`; of each run the longest parts
count that could be of the kind (four numbers up to 255, a checksum, enough digits, an at and
a dot) and meet no pattern's span.

Defined cases: a null text is as an empty one, without spans; overlapping spans of different
kinds all count; repeated rows each get a row; with no labelled sentences only the patterns
apply; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import shipped, table
from .words import BLANKS, Block, blocks

KINDS = ("email", "ip", "card", "phone")
#: Sentences of the labelled table.
SENTENCES = 900
MARGIN = 1.0
RIDGE, STEPS, RATE = 1e-3, 120, 0.15
#: Words that tell of data near them, by class.
CUES = (
    ("at", "[at]", "(at)", "{at}"),
    ("dot", "[dot]", "(dot)", "{dot}"),
    ("phone", "phone:", "tel", "tel:", "tel.", "call", "fax", "fax:", "mobile", "mobile:", "ring", "dial"),
    ("card", "card:", "visa", "visa:", "mastercard", "credit", "debit"),
    ("mail", "mail:", "email", "email:", "e-mail", "e-mail:", "write", "contact"),
    ("ip", "ip:", "host", "host:", "server", "server:", "ping", "address"),
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match can only begin where a run of digits does, so the look-behind changes nothing but the time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' finds, by start, then kind."""
    found = []
    at, end = text.find("@"), 0
    while at >= 0:  # a match's local part is the whole run of its characters before an @, from the last match on
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and at >= end and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((begin, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 2
_DIGIT = _CLASS == 3
#: Bounds of the buckets for the digits and characters of a word.
_DIGITS = np.array([1, 2, 4, 5, 9, 12, 20])
_LENGTHS = np.array([2, 4, 8, 12, 16, 24])
COARSE = 6


class Words:
    """A block's words: spans in bytes and code points, document offsets and the features of each."""

    def __init__(self, block: Block):
        data = block.data
        self.starts, self.ends, self.offsets = block.words(BLANKS)
        n = len(self.starts)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        base = points[block.offsets]
        zero = np.repeat(base[:-1], np.diff(self.offsets))
        self.begin, self.end = points[self.starts] - zero, points[self.ends] - zero
        kinds = _CLASS[data]
        keep = np.ones(len(data), bool)
        keep[1:] = kinds[1:] != kinds[:-1]
        keep[self.starts] = True
        place = np.concatenate([[0], np.cumsum(keep)])
        runs = Block(0, 1, kinds[keep], np.array([0, int(place[-1])]))
        self.shape = runs.hashes(place[self.starts], place[self.ends - 1] + keep[self.ends - 1]).view(np.int64) if n else np.zeros(0, np.int64)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        count = digits[self.ends] - digits[self.starts]
        self.digits = np.searchsorted(_DIGITS, count, "right")
        self.length = np.searchsorted(_LENGTHS, self.ends - self.starts, "right")
        marks = np.concatenate([[0], np.cumsum((kinds > 3) & (data != 44) & (data != 46))])
        marked = marks[self.ends] > marks[self.starts]
        ats = np.concatenate([[0], np.cumsum(data == 64)])
        # 0 an edge, 1 a plain word, 2 with marks, 3 with digits, 4 digits and marks, 5 with an @
        coarse = np.where(count > 0, 3, 1) + marked
        coarse[ats[self.ends] > ats[self.starts]] = 5
        self.coarse = coarse
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if n > 1:
            before[1:], after[:-1] = coarse[:-1], coarse[1:]
        before[edge[:-1]] = 0
        after[edge[1:]] = 0
        hashes, classes = _cues()
        h = block.hashes(self.starts, self.ends)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        cue = np.where(hashes[at] == h, classes[at], 0)
        earlier, later = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if n > 1:
            earlier[1:], later[:-1] = cue[:-1], cue[1:]
        earlier[edge[:-1]] = 0
        later[edge[1:]] = 0
        self.columns = (self.digits, self.length, coarse, before, after, cue, earlier, later)


@cache
def _cues() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the cue words, and the class of each, from 1."""
    words = [w for group in CUES for w in group]
    block = next(blocks(pa.array([" ".join(words)])))
    h = block.hashes(*block.words(BLANKS)[:2])
    order = np.argsort(h)
    return h[order], np.array([k + 1 for k, group in enumerate(CUES) for _ in group])[order]


WIDTHS = (len(_DIGITS) + 1, len(_LENGTHS) + 1, COARSE, COARSE, COARSE, *[len(CUES) + 1] * 3)


class CRF:
    """Tags 0 (none) to 4 (the kinds); none stands before the first word and after the last."""

    def __init__(self):
        tags = len(KINDS) + 1
        self.shapes = np.zeros(0, np.int64)
        self.tables = [np.zeros((1, tags)), *[np.zeros((w, tags)) for w in WIDTHS]]
        self.moves = np.zeros((tags, tags))
        self.learned = False

    def rows(self, shape: np.ndarray, columns: tuple) -> list[np.ndarray]:
        at = np.minimum(np.searchsorted(self.shapes, shape), max(0, len(self.shapes) - 1))
        known = self.shapes[at] == shape if len(self.shapes) else np.zeros(len(shape), bool)
        return [np.where(known, at + 1, 0), *columns]

    def evidence(self, rows: list[np.ndarray]) -> np.ndarray:
        return sum((t[r] for t, r in zip(self.tables[1:], rows[1:], strict=True)), self.tables[0][rows[0]])

    def fit(self, windows: list[tuple]) -> CRF:
        """windows: (shape, columns as rows of a matrix, tags), each a few words."""
        if not windows:
            return self
        tags = len(KINDS) + 1
        shape = np.concatenate([w[0] for w in windows])
        seen, times = np.unique(shape, return_counts=True)
        self.shapes = seen[times >= 2]
        self.tables[0] = np.zeros((len(self.shapes) + 1, tags))
        lengths = np.array([len(w[0]) for w in windows])
        longest, count = int(lengths.max()), len(windows)
        inside = np.arange(longest)[None] < lengths[:, None]
        flat = self.rows(shape, tuple(np.concatenate([w[1][:, c] for w in windows]) for c in range(len(WIDTHS))))
        padded = []
        for r in flat:
            p = np.zeros((count, longest), np.int64)
            p[inside] = r
            padded.append(p)
        gold = np.zeros((count, longest), np.int64)
        gold[inside] = np.concatenate([w[2] for w in windows])
        params = [*self.tables, self.moves]
        mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        onehot = np.eye(tags)
        truth = onehot[gold] * inside[:, :, None]
        before = np.concatenate([np.repeat(onehot[None, :1], count, 0), onehot[gold[:, :-1]]], 1)
        gold_moves = np.einsum("nta,ntb->ab", before, truth)
        gold_moves[:, 0] += onehot[gold[np.arange(count), lengths - 1]].sum(0)
        share = lambda x: x / x.sum(1, keepdims=True)
        for step in range(1, STEPS + 1):
            e = self.evidence(padded)
            psi, moves = np.exp(e - e.max(2, keepdims=True)), np.exp(self.moves - self.moves.max())
            # forward and backward, each step scaled to one
            forward, last = np.empty((longest, count, tags)), np.repeat(onehot[:1], count, 0)
            for t in range(longest):
                last = np.where(inside[:, t, None], share((last @ moves) * psi[:, t]), last)
                forward[t] = last
            both = np.zeros((tags, tags))
            both[:, 0] += share(last * moves[:, 0]).sum(0)
            error, behind = np.empty((count, longest, tags)), np.repeat(share(moves[None, :, 0]), count, 0)
            for t in range(longest - 1, -1, -1):
                live = inside[:, t, None]
                error[:, t] = share(forward[t] * behind) * live
                prior = forward[t - 1] if t else np.repeat(onehot[:1], count, 0)
                ahead = psi[:, t] * behind
                onward = ahead @ moves.T
                both += np.einsum("na,nb->ab", prior * live / (prior * onward).sum(1, keepdims=True), ahead) * moves
                behind = np.where(live, share(onward), behind)
            error -= truth
            flat_error = error.reshape(-1, tags)
            grads = [np.stack([np.bincount(r.ravel(), flat_error[:, k], len(p)) for k in range(tags)], 1) for p, r in zip(self.tables, padded, strict=True)]
            for p, g, m, v in zip(params, [*grads, both - gold_moves], mean, square, strict=True):
                g = g / count + RIDGE * p
                m[:] = 0.9 * m + 0.1 * g
                v[:] = 0.99 * v + 0.01 * g * g
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.learned = True
        return self

    def settled(self, lead: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Words that no best path tags, by how far the evidence for none is ahead in each.

        Let all words of a run be ahead by more than D. Tags on a part of the run between words without tags, or beside
        one word with a tag, gain less by transitions than they lose; tags on all of it, between two tagged words, do so
        if the run is long enough.
        """
        m, none = self.moves, self.moves[0, 0]
        start, stop = (m[:, 1:] - m[:, :1]).max(), (m[1:, :] - m[:1, :]).max()  # after any tag, before any tag
        enter, leave, onward = (m[0, 1:] - none).max(), (m[1:, 0] - none).max(), (m[1:, 1:] - none).max()
        ahead = max(enter + leave, start + leave, enter + stop, onward, 0.0) + 1.0
        least = int(max(1, np.floor((start + stop - onward) / (ahead - onward)) + 1))
        weak = lead > ahead
        cut = np.zeros(len(weak) + 1, bool)
        cut[offsets] = True
        begin = weak & (cut[:-1] | ~np.append(False, weak[:-1]))
        run = np.cumsum(begin) - 1
        sizes = np.bincount(run[weak], minlength=int(run[-1]) + 1 if len(run) else 0)
        out = weak.copy()
        out[weak] = sizes[run[weak]] >= least
        return out

    def decode(self, words: Words) -> np.ndarray:
        """The best tag of each word of a block; 0 where the path isn't ahead by MARGIN."""
        n = len(words.shape)
        tags = np.zeros(n, np.int8)
        if not self.learned or not n:
            return tags
        e = self.evidence(self.rows(words.shape, words.columns))
        settled = self.settled(e[:, 0] - e[:, 1:].max(1), words.offsets)
        unsettled = ~settled
        begin = unsettled.copy()
        begin[1:] &= settled[:-1]
        cuts = words.offsets[(words.offsets > 0) & (words.offsets < n)]
        begin[cuts] = unsettled[cuts]
        first = np.flatnonzero(begin)
        if not len(first):
            return tags
        stop = np.zeros(n + 1, bool)
        stop[1:] = unsettled & np.append(settled[1:], True)
        stop[cuts] |= unsettled[cuts - 1]
        sizes = np.flatnonzero(stop) - first
        order = np.argsort(-sizes, kind="stable")
        first, sizes = first[order], sizes[order]
        best = self.moves[0][None] + e[first]
        none = e[first, 0] + self.moves[0, 0]
        back: list[np.ndarray] = []
        for t in range(1, int(sizes[0])):
            live = int(np.searchsorted(-sizes, -t, "left"))  # segments longer than t
            step = best[:live, :, None] + self.moves[None]
            back.append(step.argmax(1).astype(np.int8))
            best[:live] = step.max(1) + e[first[:live] + t]
            none[:live] += e[first[:live] + t, 0] + self.moves[0, 0]
        final = best + self.moves[:, 0][None]
        now = final.argmax(1)
        ahead = final.max(1) - none - self.moves[0, 0] >= MARGIN
        for t in range(int(sizes[0]) - 1, -1, -1):
            live = int(np.searchsorted(-sizes, -t, "left"))
            tags[first[:live] + t] = np.where(ahead[:live], now[:live], 0)
            if t:
                now[:live] = back[t - 1][np.arange(live), now[:live]]
        return tags


def _suspect(block: Block) -> np.ndarray:
    """Which documents have any @ or digit; no pattern matches without."""
    flags = np.concatenate([[0], np.cumsum(_DIGIT[block.data] | (block.data == 64))])
    return flags[block.offsets[1:]] > flags[block.offsets[:-1]]


def _text(block: Block, d: int) -> str:
    return block.data[block.offsets[d] : block.offsets[d + 1]].tobytes().decode()


def labelled_sentences(count: int = SENTENCES, seed: int = 1) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The small labelled table: sentences with their spans (start, kind, end), made by rule, the same at each run."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 9)))
    plain = lambda: rng.choice([name(), name(), name(), name().capitalize(), name() + rng.choice(",.;:"), "the", "of", rng.choice(CUES[rng.randrange(6)])])
    marks = ("!!", "!!!", "%%%", "###", "&&&", "$$$", "***", " |", ".!!", ",%%%", "?", "-" + name(), "'s")
    styles = (plain, plain, plain, lambda: plain().upper() + rng.choice(marks[:2]), lambda: plain() + rng.choice(marks), lambda: plain() + rng.choice(marks))

    def email() -> str:
        user, host, end = rng.choice([name(), f"{name()}.{name()}", name() + digits(2)]), name(), rng.choice(["com", "org", "net", "de", "example"])
        at, dot = rng.choice([("at", "dot"), ("[at]", "[dot]"), ("(at)", "(dot)")])
        return rng.choice([f"{user}@{host}.{end}", f"{user} {at} {host} {dot} {end}", f"{user} {at} {host}.{end}", f"{user}{rng.choice(['[at]', '(at)'])}{host}.{end}"])

    def ip() -> str:
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice([".".join(parts), " . ".join(parts), "[.]".join(parts), ". ".join(parts)])

    def card() -> str:
        while True:
            n = rng.choice(["4", "5"]) + digits(15)
            if luhn(n):
                return rng.choice(["", "", " ", "-", "."]).join(n[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        own = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a} {b} {c}"])
        return rng.choice([own, own, f"+{rng.randint(1, 99)} {own}"])

    def other() -> str:
        """What looks like data and isn't."""
        d = digits
        odd = [f"20{d(2)}-0{d(1)}-1{d(1)}", f"1{d(1)}.0{d(1)}.20{d(2)}", f"v{d(1)}.{d(1)}.{d(2)}", f"{d(1)},{d(3)}.{d(2)}", f"1{d(1)}:{d(2)}", f"19{d(2)}", d(5), d(8), f"#{d(4)}", f"@{name()}", f"{d(2)}%", f"{name()}{d(3)}"]
        return rng.choice([*odd, f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(3)}-{d(2)}", f"http://{name()}.org/{d(4)}", f"{rng.choice(['at', 'call', 'card', 'dot', 'write'])} {name()}", f"{d(1)}.{d(1)} kg", f"{d(2)} of {d(3)}", "... !!! ||| --- ***", "[x] (y) {z}", "".join(rng.choice("abcdef0123456789") for _ in range(24))])

    makers, cues = (email, ip, card, phone), (CUES[4], CUES[5], CUES[3], CUES[2])
    rows = []
    for _ in range(count):
        word = rng.choice(styles)
        text, spans = " ".join(word() for _ in range(rng.randint(1, 5))), []
        for _ in range(rng.randint(1, 3)):
            k = rng.choice((0, 1, 2, 3, None, None))
            if k is not None and rng.random() < 0.4:
                text += f" {rng.choice(cues[k])}"
            made = other() if k is None else makers[k]()
            text += " "
            if k is not None:
                spans.append((len(text), k, len(text) + len(made)))
            text += made + rng.choice(["", "", "", ",", "."])
            text += "".join(" " + word() for _ in range(rng.choice((0, 1, 3, 5))))
        rows.append((text, spans))
    return rows


def trained(sentences: list[tuple[str, list[tuple[int, int, int]]]]) -> CRF:
    windows = []
    for block in blocks(pa.array([t for t, _ in sentences], pa.string())) if sentences else ():
        words = Words(block)
        columns = np.stack(words.columns, 1)
        for d in range(block.hi - block.lo):
            a, b = words.offsets[d], words.offsets[d + 1]
            tags = np.zeros(b - a, np.int64)
            for start, kind, end in sentences[block.lo + d][1]:
                tags[np.searchsorted(words.end[a:b], start, "right") : np.searchsorted(words.begin[a:b], end)] = kind + 1
            windows.append((words.shape[a:b], columns[a:b], tags))
    return CRF().fit([w for w in windows if len(w[0])])


_EDGE = " \t\n\r\f\v.,;:!?()[]{}<>\"'"
#: Words of an added span at most.
WIDEST = 8
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]+\s*(?:@|[\[({]at[\])}]|\sat\s)\s*[A-Za-z0-9-]+(?:\s*(?:\.|[\[({]dot[\])}]|\sdot\s)\s*[A-Za-z0-9-]+)+", re.IGNORECASE)
_NUMBERS = re.compile(r"[0-9]+")


def plausible(kind: int, span: str) -> bool:
    """Whether what the CRF has found could be of its kind at all."""
    digits = "".join(_NUMBERS.findall(span))
    if kind == 0:
        return _SPELLED.fullmatch(span) is not None
    if kind == 1:
        parts = _NUMBERS.findall(span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not any(c.isalpha() for c in span)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and not any(c.isalpha() for c in span)


def added_spans(words: Words, tags: np.ndarray, d: int, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of each run of words of a kind the longest plausible spans, from left to right, that meet no base span."""
    a, b = words.offsets[d], words.offsets[d + 1]
    mine = tags[a:b]
    found = []
    i = 0
    while i < len(mine):
        j = i
        while j < len(mine) and mine[i] and mine[j] == mine[i]:
            j += 1
        step = 1
        for k in range(min(j, i + WIDEST), i, -1):
            begin, end = int(words.begin[a + i]), int(words.end[a + k - 1])
            while end > begin and text[end - 1] in _EDGE:
                end -= 1
            while begin < end and text[begin] in _EDGE and not (text[begin] == "(" and ")" in text[begin:end]):
                begin += 1
            if begin < end and plausible(int(mine[i]) - 1, text[begin:end]) and not any(s < end and begin < e for s, _, e in base):
                found.append((begin, int(mine[i]) - 1, end))
                step = k - i
                break
        i += step
    return found


FOUND = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def find_personal(docs: DataFrame, model: CRF) -> DataFrame:
    """A row per document: doc_id, base counts and digest, all spans as text, how many the CRF added."""
    shipped(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def told(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            counts, digests, spans, added = [], [], [], []
            for block in blocks(batch.column(1)):
                words = Words(block)
                tags = held.value.decode(words)
                tagged = np.concatenate([[0], np.cumsum(tags > 0)])
                tagged = tagged[words.offsets[1:]] > tagged[words.offsets[:-1]]
                for d, look in enumerate(_suspect(block) | tagged):
                    if not look:
                        counts.append((0, 0, 0, 0))
                        digests.append(nothing)
                        spans.append("")
                        added.append(0)
                        continue
                    text = _text(block, d)
                    base = base_spans(text)
                    more = added_spans(words, tags, d, text, base) if tagged[d] else []
                    counts.append(tuple(sum(k == i for _, k, _ in base) for i in range(len(KINDS))))
                    digests.append(hashlib.sha256(told(base).encode()).hexdigest())
                    spans.append(told(sorted(base + more)))
                    added.append(len(more))
            table_of = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(table_of[:, i]) for i in range(len(KINDS))], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {FOUND}")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_personal(docs, trained(labelled_sentences()))
