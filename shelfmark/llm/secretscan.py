"""Secret scans: fixed patterns, and a linear-chain conditional random field over words.

The field tags each white-space-free word as begin, inside or outside of a
secret, from the shapes of the word and its two neighbours and from features
of the document, and is decoded by Viterbi. It is fitted on windows of a
bounded sample of documents: the words around pattern matches, with these as
labels, and around other words that aren't plain; and windows into which made-up
words are put, secrets that no pattern knows (tokens with a vendor's prefix,
bearer tokens, passwords in connection strings, private keys, lone random
strings) and words that only look like them (numbers of parts, dates, versions,
identifiers, addresses). So the field learns what secrets have in common beyond
the patterns. Its spans join those of the patterns where these don't cover them.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import table

#: Kinds in their order in results; the last is the method's.
KINDS = ("assign", "access", "hex", "crf")

#: Base patterns. Fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs are maximal, so shorter ones needn't be matched to be dropped
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20

#: Sample: documents used at most, about; windows of one document; words on each side of a window's centre.
SAMPLE_DOCUMENTS, WINDOWS, REACH = 5_000, 4, 6

#: Characters that a secret of the field has at least.
LEAST_FOUND = 6

#: Text that takes a secret's place.
MASK = "[secret]"

WORDS = re.compile(r"\S+")
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
FORBIDDEN = -1e4

#: Plain words in a row after which tags before and behind don't matter to each other.
RUN = 8

#: Letters and digits of made-up words, beginnings of tokens, and words before them. Fixed values.
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
PREFIXES = ("ghp_", "gho_", "ghs_", "sk-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "glpat-", "AIza", "npm_", "hf_", "dop_v1_", "SG.", "shpat_")
LEADS = ("key", "using", "with", "is", "value", "credential:", "auth:", "header", "export", "")

_KEYWORD = re.compile(r"password|passwd|pwd|secret|token|api[_-]?key|credential|auth|bearer|passphrase", re.IGNORECASE)
_PREFIX = re.compile(r"gh[pousr]_|sk[-_]|xox[abp]-|eyJ|AIza|glpat-|-----BEGIN")

#: Traits of a word that isn't plain, one bit each; they see the word, and its core without outer punctuation.
TRAITS = (
    lambda w, c: bool(_KEYWORD.search(w)),
    lambda w, c: w[-1] in "=:",
    lambda w, c: w in ("=", ":", ":=", "=>"),
    lambda w, c: "=" in w[:-1] or ":" in w[:-1],
    lambda w, c: any(x.isdigit() for x in c),
    lambda w, c: any(x.isdigit() for x in c) and any(x.isalpha() for x in c),
    lambda w, c: len(c) >= 8 and not c.strip("0123456789abcdef"),
    lambda w, c: len(c) >= 16 and bool(re.fullmatch(r"[A-Za-z0-9+/_=.-]+", c)),
    lambda w, c: any(x.islower() for x in c) and any(x.isupper() for x in c[1:]) and any(x.isdigit() for x in c),
    lambda w, c: len(c) >= 8 and bool(re.fullmatch(r"[A-Z0-9]+", c)) and not c.isdigit(),
    lambda w, c: 6 <= len(c) < 12,
    lambda w, c: 12 <= len(c) < 20,
    lambda w, c: 20 <= len(c) < 32,
    lambda w, c: len(c) >= 32,
    lambda w, c: c.startswith("AKIA"),
    lambda w, c: bool(_PREFIX.match(c)),
    lambda w, c: w[0] in "\"'`" or w[-1] in "\"'`",
    lambda w, c: sum(x.isdigit() for x in c) >= 0.3 * len(c) > 0,
    lambda w, c: c.isdigit(),
    lambda w, c: "_" in c or "-" in c,
    lambda w, c: "/" in c or "." in c,
    lambda w, c: "://" in w,
    lambda w, c: "@" in c,
    lambda w, c: len(c) >= 16 and len(set(c)) >= 0.4 * len(c),
    lambda w, c: len(c) >= 16 and c.isascii() and bool(re.search(r"[a-z][A-Z]", c)),
    lambda w, c: bool(re.search(r"://[^/\s:@]+:[^/\s@]+@", w)),
    lambda w, c: w.startswith("-----") or w.endswith("-----"),
    lambda w, c: len(re.findall(r"[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]", c)) >= 5,
    lambda w, c: bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", c)),
    lambda w, c: bool(re.search(r"(pwd|pass|passphrase|credentials?|key)[\"']?[=:]", w, re.IGNORECASE)),
    lambda w, c: c.count(".") >= 2 or c.count("-") >= 2 or c.count("/") >= 2,
)
FILE_TRAITS = 3
OUTER = ".,;:!?()[]{}<>\"'`«»“”„"


def traits_of(word: str) -> int:
    """Bits of TRAITS; 0 for plain words, which are letters but for outer punctuation and aren't keywords."""
    core = word.strip(OUTER)
    if (core.isalpha() or not core) and not _KEYWORD.search(core) and word not in ("=", ":", ":=", "=>") and not (len(core) >= 16 and re.search(r"[a-z][A-Z]", core)):
        return 0
    return sum(1 << i for i, t in enumerate(TRAITS) if t(word, core))


class TraitCache(dict):
    """Traits by word, emptied when it holds ``limit`` words."""

    limit = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = bits = traits_of(word)
        return bits


_traits = TraitCache()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def file_traits(text: str, bits: np.ndarray) -> int:
    marked = np.count_nonzero(bits)
    return int(bool((bits & 1).any())) | (2 if marked > 0.02 * len(bits) else 0) | (4 if any(c in text for c in "{};") else 0)


def unpacked(bits: np.ndarray, n: int) -> np.ndarray:
    return ((np.asarray(bits)[..., None] >> np.arange(n)) & 1).astype(np.float64)


@dataclass
class Field:
    """Weights by tag: bias, own, previous and next word's traits, document's traits, and transitions (from, to)."""

    bias: np.ndarray
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    file: np.ndarray
    move: np.ndarray

    def __post_init__(self):
        self._plain: dict[int, bool] = {}

    def emissions(self, bits: np.ndarray, file_bits: np.ndarray | int) -> np.ndarray:
        """Scores (..., word, tag) of words with such bits; beyond both ends stand plain words."""
        x = unpacked(bits, len(TRAITS))
        pad = np.zeros_like(x[..., :1, :])
        prev, nxt = np.concatenate([pad, x[..., :-1, :]], -2), np.concatenate([x[..., 1:, :], pad], -2)
        return self.bias + x @ self.own + prev @ self.before + nxt @ self.after + (unpacked(file_bits, FILE_TRAITS) @ self.file)[..., None, :]

    def plain_is_outside(self, file_bits: int) -> bool:
        """Whether stretches of RUN plain words have outside words in their middle, and at an end of the document, on every best path.

        A best path is best between any two of its words too, so it is enough
        to see the best path between each pair of tags that can stand around
        such a stretch, the ends of a document included.
        """
        if file_bits not in self._plain:
            e = np.tile(self.bias + unpacked(file_bits, FILE_TRAITS) @ self.file, (RUN, 1))
            first = [*self.move, np.array([0.0, FORBIDDEN, 0.0])]
            last = [*self.move.T, np.zeros(3)]
            sure = True
            for i, into in enumerate(first):
                for j, out in enumerate(last):
                    path = self.viterbi(e, into, out)
                    sure &= all(t == OUTSIDE for t in path[0 if i == 3 else RUN // 2 - 1 : RUN if j == 3 else RUN // 2 + 1])
            self._plain[file_bits] = sure
        return self._plain[file_bits]

    def viterbi(self, e: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[int]:
        best, back = e[0] + first, []
        for row in e[1:]:
            all_ = best[:, None] + self.move
            back.append(all_.argmax(axis=0))
            best = all_.max(axis=0) + row
        path = [int((best + last).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def tags(self, bits: np.ndarray, file_bits: int) -> dict[int, int]:
        """Words that aren't outside, by Viterbi.

        Where plain_is_outside, only stretches around words that aren't plain
        are decoded, between outside words in the middle of plain stretches.
        The words next to a marked one see it, so a stretch begins two away.
        """
        n, at, reach = len(bits), np.flatnonzero(bits), RUN // 2 + 1
        if n < 2 * RUN or not self.plain_is_outside(file_bits):
            return self._decoded(bits, file_bits, 0, n)
        out: dict[int, int] = {}
        cuts = np.flatnonzero(np.diff(at) > 2 * reach)
        for i, j in zip([0, *(cuts + 1)], [*cuts, len(at) - 1], strict=True) if len(at) else ():
            begin, end = at[i] - reach, at[j] + reach
            out |= self._decoded(bits, file_bits, begin if begin > RUN else 0, end + 1 if end < n - 1 - RUN else n)
        return out

    def _decoded(self, bits: np.ndarray, file_bits: int, i: int, j: int) -> dict[int, int]:
        if i == j:
            return {}
        inner, any_ = np.array([FORBIDDEN, FORBIDDEN, 0.0]), np.array([0.0, FORBIDDEN, 0.0])
        path = self.viterbi(self.emissions(bits[i:j], file_bits), inner if i else any_, inner if j < len(bits) else np.zeros(3))
        return {i + k: t for k, t in enumerate(path) if t != OUTSIDE}


def fitted(bits: np.ndarray, tags: np.ndarray, mask: np.ndarray, file_bits: np.ndarray, times: np.ndarray, rounds: int = 150, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximum conditional likelihood of windows (window, word), by Adam; mask: the words that exist, times: how often each window occurs."""
    n, k = len(TRAITS), 3
    sizes = {"bias": (k,), "own": (n, k), "before": (n, k), "after": (n, k), "file": (FILE_TRAITS, k), "move": (k, k)}
    w = {name: np.zeros(s) for name, s in sizes.items()}
    w["move"][OUTSIDE, INSIDE] = FORBIDDEN
    m, v = ({name: np.zeros(s) for name, s in sizes.items()} for _ in range(2))
    x = unpacked(bits, n) * mask[..., None]
    pad = np.zeros_like(x[:, :1])
    prev, nxt, f = np.concatenate([pad, x[:, :-1]], 1), np.concatenate([x[:, 1:], pad], 1), unpacked(file_bits, FILE_TRAITS)
    gold = np.eye(k)[tags] * mask[..., None]
    pair = (mask[:, 1:] * mask[:, :-1])[..., None, None]
    pair = pair * times[:, None, None, None]
    gold_move = (gold[:, :-1, :, None] * gold[:, 1:, None, :] * pair).sum((0, 1))
    start, windows, length = np.array([0.0, FORBIDDEN, 0.0]), *bits.shape
    # a window's words stand at its front, so what lies beyond them drops out of both recursions
    for t in range(1, rounds + 1):
        e = np.where(mask[..., None] > 0, w["bias"] + x @ w["own"] + prev @ w["before"] + nxt @ w["after"] + (f @ w["file"])[:, None], 0.0)
        a, b = np.zeros((length, windows, k)), np.zeros((length, windows, k))
        log_sum = lambda z, axis: (top := z.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - top).sum(axis=axis))
        a[0] = e[:, 0] + start
        for i in range(1, length):
            step = log_sum(a[i - 1][:, :, None] + w["move"], 1) + e[:, i]
            a[i] = np.where(mask[:, i, None] > 0, step, a[i - 1])
        for i in range(length - 2, -1, -1):
            step = log_sum(w["move"] + (e[:, i + 1] + b[i + 1])[:, None, :], 2)
            b[i] = np.where(mask[:, i + 1, None] > 0, step, 0.0)
        z = log_sum(a[-1], 1)
        p = np.exp(np.minimum(0, (a + b).transpose(1, 0, 2) - z[:, None, None])) * mask[..., None]
        joint = a[:-1].transpose(1, 0, 2)[..., None] + w["move"] + (e[:, 1:] + b[1:].transpose(1, 0, 2))[..., None, :] - z[:, None, None, None]
        d = (gold - p) * times[:, None, None]
        grad = {
            "bias": d.sum((0, 1)), "own": np.einsum("wln,wlk->nk", x, d), "before": np.einsum("wln,wlk->nk", prev, d), "after": np.einsum("wln,wlk->nk", nxt, d),
            "file": np.einsum("wn,wlk->nk", f, d), "move": gold_move - (np.exp(np.minimum(0, joint)) * pair).sum((0, 1)),
        }
        for name in w:
            g = grad[name] / times.sum() - decay * w[name]
            if name == "move":
                g[OUTSIDE, INSIDE] = 0
            m[name] = 0.9 * m[name] + 0.1 * g
            v[name] = 0.999 * v[name] + 0.001 * g * g
            w[name] = w[name] + rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)
        w["move"][OUTSIDE, INSIDE] = FORBIDDEN
    return Field(**w)


def made(rng: random.Random, secret: bool) -> list[tuple[str, int]]:
    """Made-up words with their tags: one secret that no base pattern need match, with the words that lead to it, or words that only look like one."""
    some = lambda letters, low, high: "".join(rng.choices(letters, k=rng.randint(low, high)))
    word, number = some(ALNUM[26:52], 3, 9), some(ALNUM[52:], 2, 6)
    lead = [(w, OUTSIDE) for w in (rng.choice(LEADS),) if w]
    mixed = lambda low, high: rng.choice(ALNUM[:26]) + some(ALNUM, low, high) + rng.choice(ALNUM[52:])
    if secret:
        kind = rng.randrange(6)
        if kind == 0:
            return [*lead, (rng.choice(PREFIXES) + some(ALNUM, 20, 40), BEGIN)]
        if kind == 1:
            token = "eyJ" + some(ALNUM, 14, 30) + "." + some(ALNUM, 20, 60) + "." + some(ALNUM + "-_", 20, 43)
            return [("Authorization:", OUTSIDE), ("Bearer", OUTSIDE), (token, BEGIN)] if rng.random() < 0.5 else [*lead, (token, BEGIN)]
        if kind == 2:
            return [*lead, (mixed(20, 44) + rng.choice(("", "", "=", "==")), BEGIN)]
        if kind == 3:
            return [*lead, (f"{rng.choice(('postgres', 'mysql', 'mongodb', 'amqp', 'redis', 'https'))}://{word}:{some(ALNUM + '!$%', 8, 18)}@{some(ALNUM[26:52], 3, 8)}.{word}:{number}/{word}", BEGIN)]
        if kind == 4:
            value, name = some(ALNUM + "!#$%&*", 8, 20), rng.choice(("pwd", "pass", "passphrase", "credential", "access_key", "PGPASS"))
            return [(f"{name}={value}", BEGIN)] if rng.random() < 0.5 else [(f"{name}:", OUTSIDE), (value + rng.choice(ALNUM[52:]), BEGIN)]
        lines = [some(ALNUM + "+/", 48, 64) for _ in range(2)]
        return [(w, INSIDE if i else BEGIN) for i, w in enumerate(("-----BEGIN", "PRIVATE", "KEY-----", *lines, "-----END", "PRIVATE", "KEY-----"))]
    hexes = "0123456789abcdef"
    shapes = (
        number + "." + number, f"{rng.randint(1970, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T10:{rng.randint(10, 59)}:00Z", "-".join(some(hexes, n, n) for n in (8, 4, 4, 4, 12)), f"v{rng.randint(0, 9)}.{number}.{rng.randint(0, 30)}",
        f"https://{word}.org/{word}/{number}/{word}.html", f"{word}.{number}@{word}.com", f"/usr/lib/{word}/{word}-{number}.so", some(hexes, 7, 10), f"{word.upper()}-{number}-{some(ALNUM[:26], 2, 3)}", word + word.title() + word.title(), f"+{number}-{number}-{number}",
        f"{word}={number}", f"{word}_{word}_{number}", f"{word}:", f"{word}/{word}/{word}.{word}", number + word, f"key={word}", f"{word.title()}{number}",
    )
    return [*lead, (rng.choice(shapes), OUTSIDE)]


def windows_of(text: str) -> list[tuple[list[int], list[int], int]]:
    """(bits, tags, file bits) of windows of a text: around up to WINDOWS pattern matches and other marked words, and, if it has words, one with a made-up secret and one with words that only look like one."""
    spots = [m.span() for m in WORDS.finditer(text)]
    bits = np.array([_traits[text[i:j]] for i, j in spots], np.int64)
    tags = np.full(len(spots), OUTSIDE)
    starts = np.array([i for i, _ in spots])
    for _, i, j in base_spans(text):
        first, last = np.searchsorted(starts, i, "right") - 1, np.searchsorted(starts, j - 1, "right") - 1
        tags[first : last + 1] = np.where(tags[first : last + 1] == OUTSIDE, INSIDE, tags[first : last + 1])
        if first == 0 or tags[first - 1] == OUTSIDE or tags[first] != INSIDE:
            tags[first] = BEGIN
    file_bits = file_traits(text, bits)
    hits, others = np.flatnonzero(tags == BEGIN), np.flatnonzero((bits > 0) & (tags == OUTSIDE))
    pick = lambda a, n: a[np.linspace(0, len(a) - 1, min(n, len(a))).astype(int)].tolist() if len(a) else []
    centres = pick(hits, WINDOWS // 2) + pick(others, WINDOWS // 2) or ([len(spots) // 2] if spots else [])
    cut = [(max(0, c - REACH), c + REACH + 1) for c in centres]
    found = [(bits[i:j].tolist(), tags[i:j].tolist(), file_bits) for i, j in cut]
    rng = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    for secret in (True, False) if spots else ():
        at, put = rng.randint(0, len(spots)), made(rng, secret)
        own, i, j = [_traits[w] for w, _ in put], max(0, at - REACH), at + REACH
        after = tags[at:j].tolist()
        if after and after[0] == INSIDE:  # what is put in ends a secret that it falls into
            after = [OUTSIDE if all(t == INSIDE for t in after[: n + 1]) else t for n, t in enumerate(after)]
        found.append(([*bits[i:at].tolist(), *own, *bits[at:j].tolist()], [*tags[i:at].tolist(), *(t for _, t in put), *after], file_bits | int(any(b & 1 for b in own))))
    return found


def trained(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> Field:
    """A field fitted on a share of docs(doc_id, text), about sample_documents of them, taken by hash of id and text.

    Null texts and texts without words give no windows; repeated rows are drawn
    together, and equal windows come to the driver once, with their number.
    """
    share = max(1, math.ceil(docs.count() / sample_documents))

    def run(batches):
        for batch in batches:
            rows = [w for t in batch.column("text").to_pylist() if t for w in windows_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.int32())], ["bits", "tags", "file_bits"])

    sample = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(share)) == 0)
    counted = sample.mapInArrow(run, "bits array<bigint>, tags array<int>, file_bits int").groupBy("bits", "tags", "file_bits").count()
    rows = [((tuple(r["bits"]), tuple(r["tags"]), r["file_bits"]), r["count"]) for r in counted.collect()]
    rows, times = zip(*sorted(rows or [(((0,), (OUTSIDE,), 0), 1)]), strict=True)
    width = max(len(r[0]) for r in rows)
    fill = lambda j, empty: np.array([[*r[j], *[empty] * (width - len(r[j]))] for r in rows], np.int64)
    mask = np.array([[1.0] * len(r[0]) + [0.0] * (width - len(r[0])) for r in rows])
    return fitted(fill(0, 0), fill(1, OUTSIDE), mask, np.array([r[2] for r in rows]), np.array(times, np.float64))


def covered(i: int, j: int, spans: list[tuple[str, int, int]]) -> bool:
    """Whether spans, by start, leave nothing of i to j."""
    for _, s, e in spans:
        if s > i:
            break
        i = max(i, e)
    return i >= j


def all_spans(text: str | None, field: Field) -> tuple[list, list]:
    """(base spans, all spans) as (kind, start, end) in code points, end exclusive, by start and then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    bits = np.fromiter(map(_traits.__getitem__, text.split()), np.int64)
    tags = field.tags(bits, file_traits(text, bits))
    if not tags:
        return base, base
    spots = [m.span() for m in WORDS.finditer(text)]
    more, at = [], sorted(tags)
    for n, k in enumerate(at):
        if tags[k] == BEGIN or not n or at[n - 1] != k - 1:
            last = k
            while tags.get(last + 1) == INSIDE:
                last += 1
            i, j = spots[k][0], spots[last][1]
            core = text[i:j]
            i += len(core) - len(core.lstrip(OUTER))
            j -= len(core) - len(core.rstrip(OUTER))
            if j - i >= LEAST_FOUND and not covered(i, j, base):
                more.append(("crf", i, j))
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in spans)


def scanned(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row of docs(doc_id, text).

    A null text is empty and has no spans; texts of any length are read whole;
    spans that begin together stand in the order of KINDS; rows that repeat
    stand each; further columns, whatever their names, are left out; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            found = [all_spans(t, shared.value) for t in batch.column("text").to_pylist()]
            counts = [[sum(k == kind for k, _, _ in base) for base, _ in found] for kind in KINDS[:3]]
            shas = [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array([listed(s) for _, s in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
        _traits.clear()  # other operators may run in this process next

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def masked(text: str | None, field: Field) -> str | None:
    """text with each stretch of secrets replaced by MASK."""
    _, spans = all_spans(text, field)
    if not spans:
        return text
    out, at = [], 0
    for _, i, j in spans:
        if i >= at:
            out += [text[at:i], MASK]
        at = max(at, j)
    return "".join([*out, text[at:]])


def op6_crf_secrets(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scanned(docs, trained(docs))


def secrets_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the secrets in their texts masked and n_chars counted anew where a text changed.

    Null and empty texts stay; rows that repeat are masked alike; every row and
    extra column stays; an empty table gives no rows.
    """
    shared = spark.sparkContext.broadcast(trained(docs))
    where = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            texts = batch.column(where).to_pylist()
            new = [masked(t, shared.value) for t in texts]
            columns = [*batch.columns]
            columns[where] = pa.array(new, batch.schema.field(where).type)
            if size is not None:
                n = [len(b) if a != b else c for a, b, c in zip(texts, new, batch.column(size).to_pylist(), strict=True)]
                columns[size] = pa.array(n, batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        _traits.clear()  # other operators may run in this process next

    return docs.mapInArrow(run, docs.schema)
