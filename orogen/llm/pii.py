"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for names and addresses."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm import labelled_names
from orogen.llm.common import in_slices

KINDS = ("email", "ip", "card", "phone", "name", "address")
BASE = 4
TAGS = ("O", "B-name", "I-name", "B-address", "I-address")
AROUND = (-2, -1, 0, 1, 2)  # how far the words stand whose features speak for a word's tag

# Words of addresses that count as themselves inside an entity; other words there are known by their form alone in every second round of training.
STREETS = set("street road lane avenue drive close court square hill way gardens rue boulevard place chemin calle avenida plaza paseo".split())
PARTICLES = {"van", "von", "der", "de", "la", "los", "del", "da", "di", "du"}  # that stand in names in lower case

# A title's or an initial's dot belongs to it and ends no sentence; a possessive 's is a word of its own.
_TOKEN = re.compile(r"(?:Mrs?|Ms|Drs?|Prof|Sra?|Srta|Mme|Mlle|Hr)\.|[A-Z]\.(?=\x20?[A-Z])|[^\W\d_]+(?:['\u2019](?!s\b)[^\W\d_]+)*|\d+|[#%&*$=~^<>_]{2,}|[^\w\s]|_|\n")
_STOP = frozenset(".!?|\n")  # signs that end a sentence, as runs of two or more of the next ones do
_RULES = frozenset("#%&*$=~^<>_")
_MARK = re.compile(r"\[([^|\]]+)\|(\w+)\]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")


def ends(word: str) -> bool:
    return word in _STOP or (len(word) > 1 and word[0] in _RULES)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches that pass their tests, sorted. Linear in the text, whatever it holds."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:  # the local part is what stands before an @, back to the end of the match before
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 40:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found)


def shape(word: str) -> str:
    """The word's shape: letter case, digits by length, or the sign itself."""
    if word[0].isdigit():
        return f"d{min(len(word), 5)}"
    if not word[0].isalpha():
        return word
    ends = word.lower()
    for ending in ("straße", "strasse", "weg", "gasse"):
        if ends.endswith(ending) and len(word) > len(ending):
            return f"X-{ending}" if word[0].isupper() else f"x-{ending}"
    if word.rstrip(".").isupper():
        return "X" if len(word.rstrip(".")) == 1 else "XX"
    return "Xx" if word[0].isupper() else "x"


def features(word: str) -> list[str]:
    """What a word is known by: itself, its shape, and its last letters together with its case."""
    low = word.lower().rstrip(".")
    case = "X" if word[0].isupper() else "x"
    return ["w=" + low, "s=" + shape(word), *(f"{case}{n}={low[-n:]}" for n in (2, 3) if word[0].isalpha() and len(low) > n)]


def hidden(words: list[str], tags: list[int]) -> list[bool]:
    """Which words of a sentence are shown by their form alone: those of entities but for streets and particles."""
    return [bool(t) and w.lower() not in STREETS | PARTICLES for w, t in zip(words, tags)]


@dataclass
class Model:
    """emit: weights by distance (-2 to 2 words), feature and tag; pairs: by the shapes of a word and of the one before it or after it; step, first: of tags. Shape 0 is the border of a sentence."""

    names: dict[str, int]
    shapes: dict[str, int]
    emit: np.ndarray
    pairs: np.ndarray
    step: np.ndarray
    first: np.ndarray

    def kind(self, word: str, form_only: bool = False) -> tuple[int, ...]:
        """The word's shape and the features that the model knows; words of one kind are the same to it."""
        own = (self.names.get(f, -1) for f in features(word)[1 if form_only else 0 :])
        return (self.shapes.get(shape(word), len(self.shapes) + 1), *(f for f in own if f >= 0))

    def rows(self, kinds: list[tuple[int, ...]]) -> np.ndarray:
        """Summed weights by distance, kind and tag; kind 0 is the outside."""
        out = np.zeros((len(AROUND), len(kinds) + 1, len(TAGS)))
        for i, (_, *own) in enumerate(kinds, 1):
            out[:, i] = self.emit[:, own].sum(axis=1)
        return out


def read_labelled(lines: Iterable[str] | None = None) -> list[tuple[list[str], list[int]]]:
    """Words and tags of the sentences of the labelled table, without the signs that end them, as the tagger sees them."""
    out = []
    for line in filter(None, map(str.strip, labelled_names.sentences() if lines is None else lines)):
        words, tags, at = [], [], 0
        for m in [*_MARK.finditer(line), None]:
            plain = _TOKEN.findall(line[at : m.start() if m else len(line)])
            words += plain
            tags += [0] * len(plain)
            if m:
                own = _TOKEN.findall(m[1])
                b = TAGS.index(f"B-{m[2]}")
                words += own
                tags += [b] + [b + 1] * (len(own) - 1)
                at = m.end()
        stops = [i for i, w in enumerate(words) if ends(w)]
        out += [(words[i:j], tags[i:j]) for i, j in zip([0, *(e + 1 for e in stops)], [*stops, len(words)]) if i < j]
    return out


def _beside(ids: np.ndarray, distance: int) -> np.ndarray:
    """Each place's neighbour at a distance; 0 beyond the row."""
    out = np.zeros_like(ids)
    if distance < 0:
        out[:, -distance:] = ids[:, :distance]
    else:
        out[:, : ids.shape[1] - distance] = ids[:, distance:]
    return out


def emissions(ids: np.ndarray, shapes: np.ndarray, rows: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Scores by tag of the words of padded rows (0: outside), from the words, their neighbours, and the shapes of words side by side."""
    own = rows[AROUND.index(0)][ids]
    for o, distance in enumerate(AROUND):
        if distance and ids.shape[1] > abs(distance):
            own += rows[o][_beside(ids, distance)]
    for o, distance in enumerate((-1, 1)):
        own += pairs[o][_beside(shapes, distance), shapes]
    return own


def _posteriors(e: np.ndarray, inside: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chances of each word's tag, summed chances of tags side by side, and the chances of the first tags, by forward and backward sums over all rows at once."""
    n, t, k = e.shape
    push, weigh = np.exp(step), np.exp(e - e.max(axis=2, keepdims=True))
    ahead, back, both = np.zeros((t, n, k)), np.ones((t, n, k)), np.zeros((k, k))
    ahead[0] = np.exp(first) * weigh[:, 0]
    ahead[0] /= ahead[0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        new = (ahead[i - 1] @ push) * weigh[:, i]
        ahead[i] = np.where(inside[:, i, None], new / new.sum(axis=1, keepdims=True), ahead[i - 1])
    for i in range(t - 2, -1, -1):
        new = (weigh[:, i + 1] * back[i + 1]) @ push.T
        back[i] = np.where(inside[:, i + 1, None], new / new.sum(axis=1, keepdims=True), 1.0)
    for i in range(1, t):
        pair = ahead[i - 1][:, :, None] * push * (weigh[:, i] * back[i])[:, None, :]
        both += (pair / pair.sum(axis=(1, 2), keepdims=True))[inside[:, i]].sum(axis=0)
    own = ahead * back
    own /= own.sum(axis=2, keepdims=True)
    return own.transpose(1, 0, 2) * inside[:, :, None], both, own[0].sum(axis=0)


def train(data: list[tuple[list[str], list[int]]], rounds: int = 120, rate: float = 0.1, l2: float = 0.3) -> Model:
    """Maximum likelihood with a quadratic penalty. In every second round the words of entities show their form alone, so that unknown names are learned too.

    Words that the table has once, and endings that fewer than three of its different words have, are no features: they stand for all unknown ones.
    """
    k = len(TAGS)
    words_of = Counter(w.lower().rstrip(".") for words, _ in data for w in words)
    ends_of = Counter(f for w in {w for words, _ in data for w in words} for f in features(w)[1:])
    known = sorted({"w=" + w for w, n in words_of.items() if n > 1} | {f for f, n in ends_of.items() if n > 2 or f.startswith("s=")})
    shapes = {s: i for i, s in enumerate(sorted({shape(w) for words, _ in data for w in words}), 1)}
    model = Model({f: i for i, f in enumerate(known)}, shapes, np.zeros((len(AROUND), len(known), k)), np.zeros((2, len(shapes) + 2, len(shapes) + 2, k)), np.zeros((k, k)), np.zeros(k))
    ban = np.array([[-50.0 if b and b % 2 == 0 and a not in (b - 1, b) else 0.0 for b in range(k)] for a in range(k)])
    start_ban = np.array([-50.0 if b and b % 2 == 0 else 0.0 for b in range(k)])
    data = [d for d in data if d[0]]
    wide = max((len(words) for words, _ in data), default=1)
    inside = np.array([[i < len(words) for i in range(wide)] for words, _ in data], bool).reshape(len(data), wide)
    kinds: dict[tuple[int, ...], int] = {}
    ids = np.zeros((2, len(data), wide), np.int64)
    right = np.zeros((len(data), wide, k))
    steps, firsts = np.zeros((k, k)), np.zeros(k)
    for r, (words, tags) in enumerate(data):
        form = hidden(words, tags)
        for i, w in enumerate(words):
            for v in range(2):
                ids[v, r, i] = kinds.setdefault(model.kind(w, bool(v) and form[i]), len(kinds) + 1)
        right[r, range(len(tags)), tags] = 1
        np.add.at(steps, (tags[:-1], tags[1:]), 1)
        firsts[tags[0]] += 1
    order = list(kinds)
    shape_of = np.array([0, *(o[0] for o in order)])
    member = np.array([(i, f) for i, o in enumerate(order, 1) for f in o[1:]]).reshape(-1, 2).T
    params = [model.emit, model.pairs, model.step, model.first]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for n in range(1, rounds + 1):
        if not data:
            break
        at = ids[n % 2]
        own, both, start = _posteriors(emissions(at, shape_of[at], model.rows(order), model.pairs), inside, model.step + ban, model.first + start_ban)
        d = own - right
        grads = [l2 * p for p in params]
        for o, distance in enumerate(AROUND):
            by_kind = np.zeros((len(order) + 1, k))
            np.add.at(by_kind, _beside(at, distance) if distance else at, d)
            np.add.at(grads[0][o], member[1], by_kind[member[0]])
        for o, distance in enumerate((-1, 1)):
            np.add.at(grads[1][o], (_beside(shape_of[at], distance), shape_of[at]), d)
        grads[2] += both - steps
        grads[3] += start - firsts
        for p, g, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)
    model.step += ban
    model.first += start_ban
    return model


def viterbi(e: np.ndarray, lengths: np.ndarray, step: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best tags of padded rows of emissions, all rows at once."""
    n, t, k = e.shape
    score = first + e[:, 0]
    from_ = np.zeros((n, t, k), np.int8)
    for i in range(1, t):
        options = score[:, :, None] + step[None]
        from_[:, i] = options.argmax(axis=1)
        new = options.max(axis=1) + e[:, i]
        score = np.where((i < lengths)[:, None], new, score)
    tags = np.zeros((n, t), np.int8)
    at = score.argmax(axis=1)
    for i in range(t - 1, -1, -1):
        inside = i < lengths
        tags[inside, i] = at[inside]
        at = np.where(inside & (i > 0), from_[np.arange(n), i, at], at)
    return tags


def trim(words: list[str], kind: int) -> tuple[int, int]:
    """First and last word of what a decoded span keeps, (0, -1) if nothing. A name goes from a capital to the last capital before a word that is neither
    capitalised, a particle, a hyphen nor a dot; an address needs a number and a capital, holds no other signs than hyphens and apostrophes, and stays whole."""
    if KINDS[kind] == "address":
        whole = any(w[0].isupper() for w in words) and any(w[0].isdigit() for w in words) and all(w[0].isalnum() or w in "-'" for w in words)
        return (0, len(words) - 1) if whole else (0, -1)
    first = next((i for i, w in enumerate(words) if w[0].isupper()), len(words))
    end = next((i for i, w in enumerate(words) if i >= first and not (w[0].isupper() or w in PARTICLES or w in "-.")), len(words))
    capitals = [i for i in range(first, end) if words[i][0].isupper()]
    return (capitals[0], capitals[-1]) if any(len(words[i].rstrip(".")) > 1 and words[i].lower() not in PARTICLES for i in capitals) else (0, -1)


class Tagger:
    """Finds the names and addresses of texts. Words are looked up once a worker; sentences of like length are decoded together.

    A sentence without a capital letter is not decoded: whatever was found there, trim() would leave nothing of it.
    """

    def __init__(self, model: Model):
        self.model = model
        self.seen: dict[str, int] = {}
        self.kinds: dict[tuple, int] = {}
        self.shapes = self.capital = np.zeros(1, np.int32)
        self.rows = model.rows([]).astype(np.float32)
        self.pairs, self.step, self.first = (p.astype(np.float32) for p in (model.pairs, model.step, model.first))

    def ids(self, words: list[str]) -> np.ndarray:
        """The kind of each word, -1 for signs that end a sentence. There are no more kinds than words and pairs of endings that the model knows."""
        seen = self.seen
        if len(seen) > 300_000:
            seen.clear()
        before = len(self.kinds)
        for w in set(words).difference(seen):
            seen[w] = -1 if ends(w) else self.kinds.setdefault((w[0].isupper(), self.model.kind(w)), len(self.kinds) + 1)
        if len(self.kinds) > before:
            new = list(self.kinds)[before:]
            self.rows = np.concatenate([self.rows, self.model.rows([kind for _, kind in new])[:, 1:].astype(np.float32)], axis=1)
            self.shapes = np.concatenate([self.shapes, np.array([kind[0] for _, kind in new], np.int32)])
            self.capital = np.concatenate([self.capital, np.array([c for c, _ in new], np.int32)])
        return np.fromiter(map(seen.__getitem__, words), np.int32, len(words))

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        words = [_TOKEN.findall(t) for t in texts]
        upto_word = np.cumsum([len(w) for w in words])
        flat = np.concatenate([*(np.append(self.ids(w), np.int32(-1)) for w in words), np.zeros(0, np.int32)])
        stops = np.flatnonzero(flat < 0)
        starts = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else np.zeros(0, np.int64)
        lengths = stops - starts
        tags = np.zeros(len(flat), np.int8)
        capitals = np.concatenate([[0], np.cumsum(self.capital[np.maximum(flat, 0)])])
        order = np.flatnonzero(capitals[stops] > capitals[starts])
        order = order[np.argsort(lengths[order], kind="stable")]
        at = 0
        while at < len(order):
            size = int(lengths[order[at]])
            upto = int(np.searchsorted(lengths[order], size + size // 8, side="right"))
            pick = order[at : min(upto, at + max(1, 400_000 // (size + 1)))]
            wide = int(lengths[pick].max())
            column = np.arange(wide)
            inside = column[None, :] < lengths[pick][:, None]
            where = np.minimum(starts[pick][:, None] + column[None, :], len(flat) - 1)
            ids = np.where(inside, flat[where], 0)
            best = viterbi(emissions(ids, self.shapes[ids], self.rows, self.pairs), lengths[pick], self.step, self.first)
            tags[where[inside]] = best[inside]
            at += len(pick)
        out: list[list[tuple[int, int, int]]] = []
        hot = np.flatnonzero(tags)
        begin = np.concatenate([[0], upto_word[:-1] + np.arange(1, len(upto_word))]) if len(upto_word) else np.zeros(0, np.int64)
        owner = np.searchsorted(begin, hot, side="right") - 1
        by_text: dict[int, list[int]] = {}
        for i, o in zip(hot.tolist(), owner.tolist()):
            by_text.setdefault(o, []).append(i - int(begin[o]))
        for o, text in enumerate(texts):
            spans: list[list[int]] = []  # first word, kind, last word
            places: list[tuple[int, int]] = []
            if o in by_text:
                places = [m.span() for m in _TOKEN.finditer(text)]
                for i in by_text[o]:
                    tag = int(tags[begin[o] + i])
                    if tag % 2 or not spans or spans[-1][2] != i - 1:
                        spans.append([i, BASE + (tag - 1) // 2, i])
                    else:
                        spans[-1][2] = i
            kept = []
            for i, kind, j in spans:
                first, last = trim([text[a:b] for a, b in places[i : j + 1]], kind)
                if last >= 0:
                    kept.append((places[i + first][0], kind, places[i + last][1]))
            out.append(kept)
        return out


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """Per text the base spans, and all spans: the random field's are left out where they meet a base span."""
    out = []
    for text, more in zip(texts, tagger(texts)):
        base = base_spans(text)
        extra = [m for m in more if not any(b[0] < m[2] and m[0] < b[2] for b in base)]
        out.append((base, sorted(base + extra)))
    return out


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _grouped(texts: list[str], tagger: Tagger):
    from orogen.llm.tokens import in_groups

    for some in in_groups(texts, 2_000_000):
        yield from zip(some, all_spans(some, tagger))


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_name, n_address of every row of docs.

    A null or empty text has no spans; a text may be of any length (sentences are decoded in batches of bounded size); repeated rows each stay a row; columns other than doc_id and text are ignored; an empty
    table gives an empty result.
    """
    model = model or train(read_labelled())
    names = ["doc_id", *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans", *(f"n_{k}" for k in KINDS[BASE:])]

    def run(batches):
        tagger = Tagger(model)
        for b in in_slices(batches, 1):
            found = [spans for _, spans in _grouped([t or "" for t in b.column(1).to_pylist()], tagger)]
            count = lambda k: pa.array([sum(s[1] == k for s in every) for _, every in found], pa.int64())
            sha = pa.array([hashlib.sha256(spell(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(count(k) for k in range(BASE)), sha, pa.array([spell(every) for _, every in found], pa.string()), *(count(k) for k in range(BASE, len(KINDS)))], names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_name long, n_address long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def mask_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the hull gets the first one's kind."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, k, e in spans:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, k, e])
    for s, k, e in merged:
        out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """docs with the personal data of its text masked.

    A null text stays null and an empty one empty; texts of any length are read whole; repeated rows each stay; the other columns, whatever their names, stay as they are; an empty table gives an empty one.
    """
    model = model or train(read_labelled())
    at = docs.columns.index(text)

    def run(batches):
        tagger = Tagger(model)
        for b in in_slices(batches, at):
            own = b.column(at).to_pylist()
            new = [mask_text(t, every) for t, (_, every) in _grouped([t or "" for t in own], tagger)]
            columns = list(b.columns)
            columns[at] = pa.array([None if o is None else n for o, n in zip(own, new)], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
