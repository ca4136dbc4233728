"""Secrets in texts: fixed patterns, and a linear-chain conditional random field over the tokens around what looks random.

The field tags tokens as a secret's begin, inside or outside. It reads the stretches of text around candidates, tokens of 12 or more
characters that are no plain words: only there can a secret begin, and what follows it may be any token.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberpanel.llm.common import arrow_map, strings

#: Kinds of pattern in the order that breaks ties; group 2 of the first must have 6 characters, the others 20 and 24.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "field")
_KEYWORD = re.compile(r"(?i)(?:pass|secret|token|key)", re.ASCII)

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
_TOKENS = re.compile(r"[A-Za-z0-9+/_-]+(?:={1,2}(?![A-Za-z0-9+/_=-]))?|[^\sA-Za-z0-9+/_-]")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{12,}")
_CONTEXT = 60
_BUCKETS = 1 << 13
_NEVER = -1e9
#: Words beside a secret, or beside what only looks like one; other words are known to the field by their shape alone.
CUES = frozenset(
    "password passwd passphrase pwd pass secret secrets token tokens key keys apikey api_key auth authorization bearer basic credential credentials private access client signature webhook login "
    "user username export set env header cookie session begin end certificate rsa "
    "order invoice card account phone tel call fax id uuid guid commit sha sha1 sha256 md5 checksum hash digest isbn iban serial version build file path url http https www image ticket tracking".split()
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns' matches, leftmost and without overlap within a kind."""
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def is_candidate(token: str) -> bool:
    """What a secret may begin with: 12 or more token characters with a digit, or with both cases behind the first; 20 or more of any kind."""
    if not _RUN.match(token):
        return False
    return len(token) >= 20 or any(c.isdigit() for c in token) or (any(c.isupper() for c in token[1:]) and any(c.islower() for c in token))


def shape(token: str) -> str:
    kinds = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "9", token)))
    return kinds if len(kinds) <= 6 else f"mixed{min(len(kinds), 20) // 4}"


def _beside(tokens: list[str], k: int) -> str:
    """What a neighbour tells: a cue by its name, another word or a number by its shape, a mark as it is."""
    if not 0 <= k < len(tokens):
        return "edge"
    low = tokens[k].lower().strip("-_=/+")
    if low in CUES:
        return low
    return tokens[k] if len(tokens[k]) == 1 else "candidate" if is_candidate(tokens[k]) else shape(tokens[k])


def _features(tokens: list[str], glued: list[bool], lines: list[bool], kind: str) -> list[list[int]]:
    """Hashed features of each token: its shape, length, alphabet and evenness, the words beside it, how it is set, and the file."""
    beside = [_beside(tokens, k) for k in range(-3, len(tokens) + 1)]
    out = []
    for k, t in enumerate(tokens):
        can, size = is_candidate(t), len(t)
        own = shape(t)
        turns = sum(own.count(c) for c in "aA9")
        letters = sum(c.isalpha() for c in t)
        vowels = sum(c in "aeiouAEIOU" for c in t)
        head = re.match(r"[A-Za-z]{2,8}(?=[_-])|eyJ", t)
        names = [
            f"shape={own}", f"length={min(size, 96) // 6}", f"hex={size > 3 and bool(re.fullmatch('[0-9a-f]+', t))}", f"digits={sum(c.isdigit() for c in t) * 6 // size}", f"distinct={len(set(t)) * 8 // min(size, 64)}",
            f"turns={can}:{min(turns * 8 // size, 6)}", f"vowels={can}:{vowels * 8 // letters if letters else 9}", f"head={can}:{head[0] if head else ''}", f"headed={can}:{bool(head)}", f"token={t if size == 1 else ''}",
            f"before={can}:{beside[k + 2]}", f"before2={can}:{beside[k + 1]}", f"before3={can}:{beside[k]}", f"after={can}:{beside[k + 4]}",
            f"glued={can}:{glued[k]}:{k + 1 < len(tokens) and glued[k + 1]}", f"line={can}:{lines[k]}", f"file={can}:{kind}", f"candidate={can}",
        ]
        out.append([zlib.crc32(f.encode()) % _BUCKETS for f in names])
    return out


def file_kind(text: str) -> str:
    """A feature of the file: whether it reads like settings or code, or like prose."""
    marks = text.count("=") + text.count("{") + text.count(";")
    return "code" if marks * 100 > len(text) else "prose"


def stretches(text: str, taken: Callable[[int, int], bool] = lambda start, end: False) -> list[list[re.Match]]:
    """Tokens around the candidates that are not ``taken``; candidates whose surroundings meet share a stretch."""
    out: list[list[int]] = []
    for found in _RUN.finditer(text):
        if taken(found.start(), found.end()) or not is_candidate(found[0]):
            continue
        begin, end = max(0, found.start() - _CONTEXT), min(len(text), found.end() + _CONTEXT)
        if out and begin <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([begin, end])
    return [list(_TOKENS.finditer(text, begin, end)) for begin, end in out]


class Chain:
    """What the field reads of a stretch: features, whether each token may begin a secret, and whether it follows without a space."""

    def __init__(self, tokens: list[re.Match], text: str, kind: str):
        words = [t[0] for t in tokens]
        self.glued = [k > 0 and tokens[k - 1].end() == t.start() for k, t in enumerate(tokens)]
        lines = [text.rfind("\n", tokens[k - 1].end() if k else max(0, t.start() - 2), t.start()) >= 0 or t.start() == 0 for k, t in enumerate(tokens)]
        self.marks = np.array(_features(words, self.glued, lines, kind), np.int64).reshape(len(words), -1)
        self.bar = np.zeros((len(words), 3))
        self.bar[[not is_candidate(w) for w in words], BEGIN] = _NEVER


class Field:
    """Weights of features by tag, and of a tag after another, apart for tokens that follow without a space.

    A secret begins at a candidate; inside comes only after begin or inside.
    """

    def __init__(self, emit: np.ndarray, step: np.ndarray):
        self.emit, self.step = emit, step

    @staticmethod
    def moves(step: np.ndarray) -> np.ndarray:
        out = step.copy()
        out[:, OUTSIDE, INSIDE] = _NEVER
        return out

    def scores(self, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, tag) and (tokens, tag before, tag); the first token follows an outside one."""
        return self.emit[chain.marks].sum(1) + chain.bar, self.moves(self.step)[np.array(chain.glued, int)]

    def decode(self, chain: Chain) -> list[int]:
        """Viterbi tags."""
        own, moves = self.scores(chain)
        best, back = np.array([0.0, _NEVER, _NEVER]), []
        for here, move in zip(own, moves, strict=True):
            ways = best[:, None] + move + here
            back.append(ways.argmax(0))
            best = ways.max(0)
        tags = [int(best.argmax())]
        for came in back[:0:-1]:
            tags.append(int(came[tags[-1]]))
        return tags[::-1]

    def log_total(self, chain: Chain) -> float:
        """Logarithm of the sum over all tag sequences."""
        own, moves = self.scores(chain)
        alpha = np.array([0.0, _NEVER, _NEVER])
        for here, move in zip(own, moves, strict=True):
            alpha = here + np.logaddexp.reduce(alpha[:, None] + move, 0)
        return float(np.logaddexp.reduce(alpha))


_CONSONANTS, _VOWELS = "bcdfghjklmnprstvwz", "aeiou"
_ALPHABETS = {
    "hex": "0123456789abcdef",
    "base": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "low": "abcdefghijklmnopqrstuvwxyz0123456789",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
}
#: Heads of public kinds of keys, their alphabet and length.
_HEADS = (("ghp_", "base", 36), ("github_pat_", "base", 60), ("sk-", "base", 40), ("xoxb-", "low", 40), ("AIza", "url", 35), ("glpat-", "url", 20), ("sk_live_", "base", 24), ("npm_", "base", 36), ("hf_", "letters", 34))


class _Maker:
    """Labelled texts made by rule: files of prose or code with secrets of public kinds, and with look-alikes that are none."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def draw(self, kind: str, size: int) -> str:
        return "".join(self.rng.choices(_ALPHABETS[kind], k=size))

    def word(self) -> str:
        rng = self.rng
        out = "".join(rng.choice(_CONSONANTS) + rng.choice(_VOWELS) + (rng.choice(_CONSONANTS) if rng.random() < 0.3 else "") for _ in range(rng.choices((1, 2, 3, 5, 8), (6, 8, 4, 2, 1))[0]))
        return out.capitalize() if rng.random() < 0.15 else out

    def name(self) -> str:
        return self.rng.choice(("_".join((self.word(), self.word())), self.word() + self.word().capitalize() + self.word().capitalize(), self.word()))

    def secret(self) -> str:
        rng, roll = self.rng, self.rng.random()
        if roll < 0.4:
            head, kind, size = rng.choice(_HEADS)
            return head + self.draw(kind, size)
        if roll < 0.65:  # signed web tokens: parts with marks between
            return "eyJ" + self.draw("url", rng.randint(17, 40)) + "." + "eyJ" * (rng.random() < 0.7) + self.draw("url", rng.randint(20, 90)) + "." + self.draw("url", 43)
        if roll < 0.8:  # a key's body: lines of equal length
            return "\n".join(self.draw("b64", 64) for _ in range(rng.randint(2, 5))) + "\n" + self.draw("b64", rng.randint(16, 60)) + "=" * rng.randint(0, 2)
        if roll < 0.9:
            return ":".join((self.draw("base", rng.randint(12, 20)), self.draw("url", rng.randint(24, 40))))
        return self.draw(rng.choice(("base", "url", "letters")), rng.randint(24, 64))

    def lookalike(self) -> str:
        rng = self.rng
        digits = lambda n: "".join(rng.choices("0123456789", k=n))
        date = f"20{rng.randint(10, 29)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}"
        return rng.choice((
            digits(rng.randint(12, 20)), "+" + digits(12), f"{date}T{digits(2)}", "-".join(digits(4) for _ in range(4)), "-".join(self.draw("hex", k) for k in (8, 4, 4, 4, 12)),
            "-".join((self.word(), self.word(), self.word(), digits(3))), "".join((self.word(), self.word(), self.word(), digits(2))), f"/{self.word()}/{self.word()}/{self.word()}_{digits(5)}",
            self.name() + self.name().capitalize() + self.word().capitalize(), "".join(self.word() for _ in range(5)), f"{self.word()}_{self.word()}_{digits(3)}", "=" * rng.randint(12, 40), "-" * rng.randint(12, 40),
            f"v{digits(1)}-{digits(2)}-{digits(8)}-{self.word()}", f"{self.word()}/{self.word()}/{digits(6)}",
        ))

    def text(self) -> tuple[str, list[tuple[int, int]]]:
        rng = self.rng
        code, out, spans, at = rng.random() < 0.5, [], [], 0

        def put(piece: str, secret: bool = False) -> None:
            nonlocal at
            if secret:
                spans.append((at, at + len(piece)))
            out.append(piece)
            at += len(piece)

        for _ in range(rng.randint(2, 6)):
            roll, quote = rng.random(), rng.choice(("", '"', "'")) if code else ""
            hidden = roll < 0.3
            thing = self.secret() if hidden else self.lookalike() if roll < 0.65 else self.word()
            good = ("key", "token", "secret", "password", "auth", "credential", "client_secret", "Bearer", "Authorization", "access key", "private key")
            poor = ("id", "order", "commit", "checksum", "version", "file", "path", "phone", "uuid", "card", "image", self.name())
            cue = rng.choice(good) if rng.random() < (0.7 if hidden else 0.1) else rng.choice(poor)
            if "\n" in thing:
                put(f"-----BEGIN {rng.choice(('RSA ', 'EC ', ''))}PRIVATE KEY-----\n")
                put(thing, hidden)
                put("\n-----END PRIVATE KEY-----\n")
                continue
            if code:
                put(rng.choice((f"{self.name()} = {self.name()}({self.word()});\n", f"if {self.word()} {{\n", "")))
                put(f"{cue.replace(' ', '_')}{rng.choice((' = ', ': ', '=', ' ', ', '))}{quote}")
                put(thing, hidden)
                put(f"{quote}{rng.choice((';', '', ','))}\n")
            else:
                put(" ".join([*(self.word() for _ in range(rng.randint(1, 9))), *([cue] if rng.random() < 0.6 else []), *rng.choice(([], ["is"], [":"], ["with", "the"]))]) + " ")
                put(thing, hidden)
                put(rng.choice(("", ".", ",", " ")) + " " + " ".join(self.word() for _ in range(rng.randint(0, 9))) + rng.choice((".", "\n", ". ")))
        return "".join(out), spans


def tags_of(tokens: list[re.Match], spans: list[tuple[int, int]]) -> list[int]:
    out = []
    for t in tokens:
        own = next(((s, e) for s, e in spans if s <= t.start() and t.end() <= e), None)
        out.append(OUTSIDE if own is None else BEGIN if t.start() == own[0] else INSIDE)
    return out


def examples(rng: random.Random, n: int) -> list[tuple[Chain, list[int]]]:
    """Labelled chains of ``n`` made texts."""
    make, out = _Maker(rng), []
    for _ in range(n):
        text, spans = make.text()
        out += [(Chain(tokens, text, file_kind(text)), tags_of(tokens, spans)) for tokens in stretches(text)]
    return out


def train(seed: int = 7, n: int = 500, rounds: int = 60, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """Maximise the conditional likelihood of made examples by gradient steps (Adam), with forward and backward sums over all tags."""
    data = [(c, y) for c, y in examples(random.Random(seed), n) if not any(t == INSIDE and (k == 0 or y[k - 1] == OUTSIDE) for k, t in enumerate(y)) and not any(t == BEGIN and c.bar[k, BEGIN] for k, t in enumerate(y))]
    n, longest = len(data), max(len(y) for _, y in data)
    width = data[0][0].marks.shape[1]
    marks, tags, real = np.zeros((n, longest, width), np.int64), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    bar, glued = np.zeros((n, longest, 3)), np.zeros((n, longest), np.int64)
    bar[:, :, 1:] = _NEVER  # padding is outside and adds nothing
    for k, (chain, own) in enumerate(data):
        size = len(own)
        marks[k, :size], tags[k, :size], real[k, :size], bar[k, :size], glued[k, :size] = chain.marks, own, True, chain.bar, chain.glued
    emit, step = np.zeros((_BUCKETS, 3)), np.zeros((2, 3, 3))
    before = np.concatenate((np.zeros((n, 1), np.int64), tags[:, :-1]), 1)
    moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(step), np.zeros_like(step)]
    where = marks[real].ravel()
    live = real[:, :, None, None]
    rows = np.arange(n)
    for turn in range(1, rounds + 1):
        score = bar.copy()
        score[real] += emit[marks[real]].sum(1)
        score -= score.max(2, keepdims=True)
        odds, moves = np.exp(score), np.exp(Field.moves(step))
        move = np.where(live, moves[glued], 1.0)
        # Sums are scaled to 1 at each token, forward and backward alike.
        alpha, beta, scale = np.zeros((n, longest, 3)), np.ones((n, longest, 3)), np.ones((n, longest))
        for t in range(longest):
            here = (move[:, 0, OUTSIDE] if t == 0 else (alpha[:, t - 1, :, None] * move[:, t]).sum(1)) * odds[:, t]
            scale[:, t] = here.sum(1)
            alpha[:, t] = here / scale[:, t, None]
        for t in range(longest - 2, -1, -1):
            beta[:, t] = (move[:, t + 1] * (odds[:, t + 1] * beta[:, t + 1])[:, None, :]).sum(2) / scale[:, t + 1, None]
        node = alpha * beta
        edge = alpha[:, :-1, :, None] * move[:, 1:] * ((odds * beta)[:, 1:] / scale[:, 1:, None])[:, :, None, :] * live[:, 1:]
        slope_step = np.stack([edge[glued[:, 1:] == g].sum(0) for g in (0, 1)])
        slope_step[0, OUTSIDE] += node[:, 0].sum(0)
        np.subtract.at(slope_step, (glued[real], before[real], tags[real]), 1)
        node[rows[:, None], np.arange(longest), tags] -= 1
        flat = np.repeat(node[real], width, 0)
        slope_emit = np.stack([np.bincount(where, flat[:, c], _BUCKETS) for c in range(3)], 1)
        for w, g, m, v in ((emit, slope_emit / n + decay * emit, moments[0], moments[1]), (step, slope_step / n + decay * step, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return Field(emit, step)


def field_spans(text: str, field: Field, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the field tags and that no fixed pattern's match touches."""
    joined: list[list[int]] = []
    for s, e, _ in base:
        if joined and s <= joined[-1][1]:
            joined[-1][1] = max(e, joined[-1][1])
        else:
            joined.append([s, e])
    ends = [e for _, e in joined]

    def taken(start: int, end: int) -> bool:
        at = bisect_right(ends, start)
        return at < len(joined) and joined[at][0] < end

    out: list[tuple[int, int, int]] = []
    found = stretches(text, taken)
    kind = file_kind(text) if found else ""
    for tokens in found:
        open_: list[int] | None = None
        for token, tag in zip(tokens, field.decode(Chain(tokens, text, kind)), strict=True):
            if open_ and tag != INSIDE:
                out.append((*open_, 3))
                open_ = None
            if tag == BEGIN:
                open_ = [token.start(), token.end()]
            elif tag == INSIDE:
                open_[1] = token.end()
        if open_:
            out.append((*open_, 3))
    return [s for s in out if not taken(s[0], s[1])]


def find_secrets(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Secrets of each whole text: ``keep``, ``id_col``, n_assign, n_access, n_hex, base_sha256, spans, n_field, redacted.

    ``spans`` is kind:start:end of every span by start, then kind (assign, access, hex, field), joined by commas; offsets are code
    points, the end exclusive. ``base_sha256`` digests the same of the fixed patterns alone. Spans of different fixed kinds may
    overlap; a field span touches none of them. ``redacted`` is the text with each run of spans replaced by ``[SECRET]``. Null
    text is empty. Whole texts are scanned, in time that grows with their length. Repeated rows and null ids pass through row by
    row. An empty table gives no rows. Other columns are ignored.
    """
    source = docs.select(F.struct(F.col(id_col).alias("_id"), *[F.col(c).alias(f"k_{c}") for c in keep]).alias("_kept"), F.col(text_col).alias("_text"))
    kept_type = source.schema["_kept"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: list[list[int]] = [[], [], [], []]
        digests, listed, redacted = [], [], []
        for text in strings(batch, "_text"):
            base = base_spans(text)
            every = sorted(base + field_spans(text, field, base), key=lambda s: (s[0], s[2]))
            named = [f"{KINDS[k]}:{s}:{e}" for s, e, k in base]
            digests.append(hashlib.sha256(",".join(named).encode()).hexdigest())
            listed.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in every))
            for k in range(4):
                counts[k].append(sum(x[2] == k for x in every))
            parts, at = [], 0
            for s, e, _ in every:
                if s >= at:
                    parts += [text[at:s], "[SECRET]"]
                at = max(at, e)
            redacted.append("".join([*parts, text[at:]]))
        arrays = [batch.column("_kept"), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(digests), pa.array(listed), pa.array(counts[3], pa.int64()), pa.array(redacted)]
        return pa.RecordBatch.from_arrays(arrays, names=["_kept", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_field", "redacted"])

    out = arrow_map(source, f"_kept {kept_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_field long, redacted string", work)
    return out.select(F.col("_kept._id").alias(id_col), *[F.col(f"_kept.k_{c}").alias(c) for c in keep], "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_field", "redacted")
