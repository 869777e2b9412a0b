"""Operator 11: personal data by fixed patterns and a character-level BiLSTM with CRF transitions.

The patterns give the base spans. The network reads every text in overlapping windows of characters:
an LSTM each way (soft-sign gates, its input weights folded into a row for each character class), and
linear-chain CRF scores over the tags "other" and one for each kind. It is trained in numpy, by Adam on the exact gradient
of the CRF's likelihood, from labelled spans: those of a bounded sample of documents by the patterns, and written
forms that the patterns miss (``WRITTEN``), put into windows of these texts. Viterbi decodes each window; what
windows find is reconciled over the whole text: pieces of one kind that touch unite, the better scored of two
kinds that overlap wins, and what overlaps a base span goes. So the method adds spans and base ones stay.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sample import draw
from ._spark import by_slice

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and from one window's start to the next one's.
WINDOW, STRIDE = 448, 384
#: Windows that are decoded at once, hidden units of each direction, size of a class's vector, character classes.
TOGETHER, HIDDEN, EMBED, CLASSES = 1024, 8, 10, 100
#: Score by which a span must beat "other" to be added.
MARGIN = 1.0
#: Documents of the sample and the characters that are taken of each, training windows, their characters, windows in a step, passes, rate.
ROWS, STRETCH, SAMPLES, LENGTH, BATCH, PASSES, RATE = 1500, 8000, 6000, 96, 80, 7, 0.02
TAGS = len(KINDS) + 1

AT_SIGN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
BEFORE_AT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts or ends within a run of digits, so looking back only saves time.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[::-2])
    return (total + sum(2 * int(c) - 9 * (c > "4") for c in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, sorted; linear in the text.

    Mail addresses are found from their @, back over the letters before it as far as the last match.
    """
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in BEFORE_AT:
            start -= 1
        found = AT_SIGN.match(text, at) if start < at else None
        last = found.end() if found else at + 1
        if found:
            out.append((start, 0, last))
        at = text.find("@", last)
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def _class_table() -> np.ndarray:
    """A class for each code point below 1024: one for each of ASCII's printing characters, and a few for the rest."""
    out = np.full(1024, 95, np.uint8)
    out[32:127] = np.arange(95)
    out[[9, 11, 12, 13, 133, 160]] = 0
    out[10] = 96
    for c in range(160, 1024):
        out[c] = 97 if chr(c).isalpha() else 95
    return out


CLASS_OF = _class_table()
FAR_CLASS, PAD = 98, 99


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 1024, CLASS_OF[np.minimum(points, 1023)], np.uint8(FAR_CLASS))


@dataclass
class Network:
    """Weights; axis 0 of those of the LSTMs is the direction, gates lie in the order input, forget, output, cell."""

    embed: np.ndarray
    read: np.ndarray
    again: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    out_shift: np.ndarray
    move: np.ndarray
    begin: np.ndarray

    def names(self) -> list[str]:
        return list(self.__dataclass_fields__)


def start(seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    draw_ = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
    shift = np.zeros((2, 4 * HIDDEN), np.float32)
    shift[:, HIDDEN : 2 * HIDDEN] = 1
    return Network(rng.standard_normal((CLASSES, EMBED)).astype(np.float32) * 0.7, draw_(2, EMBED, 4 * HIDDEN), draw_(2, HIDDEN, 4 * HIDDEN), shift, draw_(2, HIDDEN, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32))


def _softsign(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def emissions(net: Network, codes: np.ndarray) -> np.ndarray:
    """Tag scores (time, tag, window) of windows of classes (time, window); PAD at the ends leaves the state at rest."""
    steps, n = codes.shape
    out = np.empty((steps, TAGS, n), np.float32)
    out[:] = net.out_shift[:, None]
    # Gates lie one behind another, so that every step works on whole stretches of memory.
    gates, spare = np.empty((4, n, HIDDEN), np.float32), np.empty((4, n, HIDDEN), np.float32)
    scores = np.empty((n, TAGS), np.float32)
    for way in (0, 1):
        table = (net.embed @ net.read[way] + net.shift[way]).astype(np.float32)
        # A resting class: input shut, forgetting all, so that padding never reaches the text.
        table[PAD] = 0
        table[PAD, : 3 * HIDDEN] = -1e6
        table = np.ascontiguousarray(table.reshape(CLASSES, 4, HIDDEN).transpose(1, 0, 2))
        again = np.ascontiguousarray(net.again[way].reshape(HIDDEN, 4, HIDDEN).transpose(1, 0, 2))
        h, c, size = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.empty((n, HIDDEN), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            np.matmul(h, again, out=gates)
            np.take(table, codes[t], axis=1, out=spare, mode="clip")
            gates += spare
            np.abs(gates, out=spare)
            spare += 1
            gates /= spare
            opened = gates[:3]
            opened *= 0.5
            opened += 0.5
            c *= gates[1]
            gates[0] *= gates[3]
            c += gates[0]
            np.abs(c, out=size)
            size += 1
            np.divide(c, size, out=h)
            h *= gates[2]
            np.matmul(h, net.out[way], out=scores)
            out[t] += scores.T
    return out


def decode(net: Network, scores: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(window, start, end, kind, score over "other") of every span on the windows' best paths.

    Windows whose best path beats "other" throughout by less than MARGIN / 2 hold no span of MARGIN and aren't walked back.
    """
    steps, _, n = scores.shape
    best = np.empty_like(scores)
    best[0] = scores[0] + net.begin[:, None]
    plain = best[0, 0].copy()
    other, move, stay = np.empty((TAGS, n), np.float32), net.move[:, :, None], float(net.move[0, 0])
    shortest = int(sizes.min())
    for t in range(1, steps):
        now, reach = best[t - 1], best[t]
        np.add(now[0], move[0], out=reach)
        for i in range(1, TAGS):
            np.add(now[i], move[i], out=other)
            np.maximum(reach, other, out=reach)
        reach += scores[t]
        if t < shortest:
            plain += scores[t, 0] + stay
        else:
            over = t >= sizes
            reach[:, over] = now[:, over]
            plain += np.where(over, 0, scores[t, 0] + stay)
    out = []
    for w in np.flatnonzero(best[-1].max(0) > plain + MARGIN / 2):
        size = int(sizes[w])
        tags = np.empty(size, np.int64)
        tags[-1] = best[size - 1, :, w].argmax()
        for t in range(size - 2, -1, -1):
            tags[t] = (best[t, :, w] + net.move[:, tags[t + 1]]).argmax()
        edge = np.flatnonzero(np.diff(tags, prepend=-1, append=-1))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if k := int(tags[a]):
                own = scores[a:b, k, w].sum() - scores[a:b, 0, w].sum() + (b - a - 1) * (net.move[k, k] - net.move[0, 0])
                own += net.move[0, k] - net.move[0, 0] if a else net.begin[k] - net.begin[0]
                own += net.move[k, 0] - net.move[0, 0] if b < size else 0
                out.append((int(w), int(a), int(b), k - 1, float(own)))
    return out


def windows(n: int) -> list[tuple[int, int]]:
    """(start, end) of the windows over n characters; the last one ends with the text."""
    return [(a, min(n, a + WINDOW)) for a in range(0, max(1, n - WINDOW + STRIDE), STRIDE)] if n else []


def found_spans(net: Network, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """(start, end, kind, score) of what each text's windows hold, in places of the text, not yet reconciled."""
    codes = [classes(t) for t in texts]
    cut = sorted(((b - a, i, a) for i, c in enumerate(codes) for a, b in windows(len(c))), reverse=True)
    out: list[list] = [[] for _ in texts]
    for at in range(0, len(cut), TOGETHER):
        some = cut[at : at + TOGETHER]
        held = np.full((some[0][0], len(some)), PAD, np.uint8)
        for w, (size, i, a) in enumerate(some):
            held[:size, w] = codes[i][a : a + size]
        for w, a, b, k, score in decode(net, emissions(net, held), np.array([s[0] for s in some])):
            _, i, first = some[w]
            out[i].append((first + a, first + b, k, score))
    return out


def reconcile(text: str, found: list[tuple[int, int, int, float]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what is added to ``base``.

    Pieces of one kind that overlap or touch unite, with the best of their scores; then spans are taken by
    falling score (ties: the earlier one) where nothing taken and no base span overlaps; what is of too low a score, or can't be of its kind by its digits and letters, goes.
    """
    joined: list[list] = []
    for a, b, k, score in sorted(found, key=lambda s: (s[2], s[0], s[1])):
        if joined and joined[-1][2] == k and a <= joined[-1][1]:
            joined[-1][1], joined[-1][3] = max(joined[-1][1], b), max(joined[-1][3], score)
        else:
            joined.append([a, b, k, score])
    taken: list[tuple[int, int, int]] = []
    blocks = [(a, b) for a, _, b in base]
    for a, b, k, score in sorted(joined, key=lambda s: (-s[3], s[0], s[1], s[2])):
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        if score >= MARGIN and plausible(text[a:b], k) and all(b <= x or y <= a for x, y in blocks):
            taken.append((a, k, b))
            blocks.append((a, b))
    return sorted(taken)


def plausible(piece: str, kind: int) -> bool:
    """What any span of the kind has: a mail address two parts and a mark between, an address four numbers, a card or phone its number of digits."""
    digits = NOT_DIGIT.sub("", piece)
    if kind == 0:
        return len(piece) >= 8 and ("@" in piece or bool(re.search(r"\bat\b", piece, re.I)))
    if kind == 1:
        parts = re.findall("[0-9]+", piece)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


def _fill(form: str, rng: random.Random, words: list[str]) -> str:
    """A form with its marks filled: w a word, # a digit, c a number up to 255, C the 16 digits of a card in fours parted by what follows C."""
    out = []
    i = 0
    while i < len(form):
        c = form[i]
        if c == "C":
            i += 1
            body = [rng.randrange(10) for _ in range(15)]
            body.append(next(d for d in range(10) if luhn("".join(map(str, [*body, d])))))
            out.append(form[i].join("".join(map(str, body[j : j + 4])) for j in (0, 4, 8, 12)))
        else:
            out.append({"w": lambda: rng.choice(words), "#": lambda: str(rng.randrange(10)), "c": lambda: str(rng.randrange(256))}.get(c, lambda: c)())
        i += 1
    return "".join(out)


# Written forms of each kind, the first of a kind as the patterns have it.
WRITTEN = {
    0: ("w.##@w#.w.com", "w@w.org", "w (at) w (dot) com", "w.## [at] w [dot] org", "w at w dot com", "w_w AT w DOT net", "w@w(dot)com", "w.w@ w.com", "w @ w.de"),
    1: ("c.c.c.c", "c[.]c[.]c[.]c", "c(.)c(.)c(.)c", "c. c. c. c", "c dot c dot c dot c"),
    2: ("C-", "C ", "C.", "C/", "C_", "C  "),
    3: ("+1 (###) ###-####", "+## ### #######", "(###) ###-####", "1-###-###-####", "00## ### ### ####", "###-###-####", "tel. ### ### ####", "0### / #######", "+ 1 ### ### ####"),
}
# What looks like personal data and is none.
DECOYS = ("####-##-##", "v#.#.##", "#.#.#", "##:##:##", "$#,###.##", "#####", "####", "############", "w##w####", "#.###.###", "x#f##b#a####e##d#", "## ### ## #", "w at w", "from w at the w", "###/####", "c.c", "order ########", "#e-##", "###-##", "@w", "w/w/##.html")


def labelled_windows(texts: list[str], n: int = SAMPLES, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(classes, tags), both (LENGTH, n): stretches of the texts as the patterns label them, most with a written form or a decoy put in."""
    rng = random.Random(seed)
    texts = [t for t in texts if t] or ["the words of a text and of another"]
    words = sorted({w for t in texts[:300] for w in re.findall("[a-zà-ÿ]{3,9}", t[:2000])}) or ["word"]
    codes, tags = np.full((LENGTH, n), PAD, np.uint8), np.zeros((LENGTH, n), np.uint8)
    for w in range(n):
        text = rng.choice(texts)
        at = rng.randrange(max(1, len(text) - LENGTH + 1))
        near = base_spans(text) if w % 3 == 0 and len(text) < 20_000 else []
        if near:
            at = max(0, rng.choice(near)[0] - rng.randrange(LENGTH // 2))
        piece = text[at : at + LENGTH]
        if w % 3:
            put = [_fill(rng.choice(DECOYS), rng, words), None] if w % 9 == 1 else None
            if put is None:
                kind = rng.randrange(len(KINDS))
                form = WRITTEN[kind][0] if rng.random() < 0.2 else rng.choice(WRITTEN[kind])
                put = [_fill(form, rng, words), kind]
            spot = rng.randrange(max(1, min(len(piece), LENGTH - 12)))
            spot = piece.rfind(" ", 0, spot) + 1 if rng.random() < 0.9 else spot
            lead, tail = piece[:spot], piece[spot:]
            piece = (lead + put[0] + rng.choice((" ", " ", ". ", ", ", "\n")) + tail)[:LENGTH]
        else:
            spot, put = 0, ["", None]
        held = classes(piece)
        codes[: len(held), w] = held
        for a, k, b in base_spans(piece):
            tags[a:b, w] = k + 1
        if put[1] is not None:
            skip = 5 if put[0].startswith("tel.") else 0
            tags[spot + skip : spot + len(put[0]), w] = put[1] + 1
    return codes, tags


def loss_and_slopes(net: Network, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean negative log-likelihood of the tags of windows (time, window), and its gradient by every weight."""
    steps, n = codes.shape
    h3, kept = 3 * HIDDEN, []
    scores = np.zeros((steps, n, TAGS), np.float32) + net.out_shift
    on = (codes != PAD).astype(np.float32)[:, :, None]
    for way in (0, 1):
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        x = net.embed[codes]
        fed = x @ net.read[way] + net.shift[way]
        track = []
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            z = fed[t] + h @ net.again[way]
            g = _softsign(z)
            g[:, :h3] = 0.5 * g[:, :h3] + 0.5
            new = g[:, HIDDEN : 2 * HIDDEN] * c + g[:, :HIDDEN] * g[:, h3:]
            new *= on[t]
            s = _softsign(new)
            track.append((t, h, c, z, g, new, s))
            h, c = s * g[:, 2 * HIDDEN : h3] * on[t], new
            scores[t] += h @ net.out[way]
        kept.append((x, track))
    # Forward and backward sums of the CRF.
    fore = np.empty((steps, n, TAGS), np.float64)
    back = np.zeros((steps, n, TAGS), np.float64)
    wide, move = scores.astype(np.float64), net.move.astype(np.float64)
    fore[0] = wide[0] + net.begin
    logsum = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
    for t in range(1, steps):
        fore[t] = np.where(on[t] > 0, logsum(fore[t - 1][:, :, None] + move, 1) + wide[t], fore[t - 1])
    for t in range(steps - 2, -1, -1):
        back[t] = np.where(on[t + 1] > 0, logsum(move + (wide[t + 1] + back[t + 1])[:, None, :], 2), back[t + 1])
    total = logsum(fore[-1], 1)
    share = np.exp(np.minimum(0.0, fore + back - total[:, None])) * on
    chosen = np.eye(TAGS)[tags] * on
    d_scores = ((share - chosen) / n).astype(np.float32)
    gold = (wide * chosen).sum((0, 2)) + net.begin[tags[0]]
    d_move = np.zeros((TAGS, TAGS))
    for t in range(1, steps):
        both = np.exp(np.minimum(0.0, fore[t - 1][:, :, None] + move + (wide[t] + back[t])[:, None, :] - total[:, None, None])) * on[t][:, :, None]
        d_move += both.sum(0) - chosen[t - 1].T @ chosen[t]
        gold += move[tags[t - 1], tags[t]] * on[t, :, 0]
    slopes = {k: np.zeros_like(getattr(net, k)) for k in net.names()}
    slopes["move"] = (d_move / n).astype(np.float32)
    slopes["begin"] = d_scores[0].sum(0)
    slopes["out_shift"] = d_scores.sum((0, 1))
    d_x = np.zeros((steps, n, EMBED), np.float32)
    for way in (0, 1):
        x, track = kept[way]
        d_h, d_c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for t, h, c, z, g, new, s in reversed(track):
            o = g[:, 2 * HIDDEN : h3]
            slopes["out"][way] += (s * o * on[t]).T @ d_scores[t]
            d_h = (d_h + d_scores[t] @ net.out[way].T) * on[t]
            d_c = (d_c + d_h * o / (1 + np.abs(new)) ** 2) * on[t]
            d_g = np.concatenate([d_c * g[:, h3:], d_c * c, d_h * s, d_c * g[:, :HIDDEN]], 1)
            d_g[:, :h3] *= 0.5
            d_z = d_g / (1 + np.abs(z)) ** 2
            slopes["again"][way] += h.T @ d_z
            slopes["read"][way] += x[t].T @ d_z
            slopes["shift"][way] += d_z.sum(0)
            d_x[t] += d_z @ net.read[way].T
            d_h, d_c = d_z @ net.again[way].T, d_c * g[:, HIDDEN : 2 * HIDDEN]
    np.add.at(slopes["embed"], codes.ravel(), d_x.reshape(-1, EMBED))
    return float((total - gold).mean()), slopes


def fit(texts: list[str], seed: int = 11, passes: int = PASSES, n: int = SAMPLES) -> Network:
    """Trains on windows of the texts; the same texts in the same order give the same network."""
    net = start(seed)
    codes, tags = labelled_windows(texts, n, seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(getattr(net, k)) for k in net.names()}
    second = {k: np.zeros_like(getattr(net, k)) for k in net.names()}
    step, total = 0, passes * -(-n // BATCH)
    for _ in range(passes):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            some = order[at : at + BATCH]
            _, slopes = loss_and_slopes(net, codes[:, some], tags[:, some])
            size = np.sqrt(sum(float((g * g).sum()) for g in slopes.values()))
            step += 1
            rate = RATE * min(1.0, 2 * (1 - step / (total + 1)))
            for k, g in slopes.items():
                g = g * min(1.0, 5.0 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
                setattr(net, k, (getattr(net, k) - rate * move).astype(np.float32))
    return net


def train(docs: DataFrame, n: int = ROWS) -> Network:
    """Fits on about ``n`` documents drawn by a hash of doc_id, on a stretch of STRETCH characters of each, whose place the hash draws too."""
    room = F.greatest(F.lit(1), F.char_length("text") - STRETCH + 1)
    place = (F.pmod(F.xxhash64("doc_id", F.lit("place")), room) + 1).cast("int")
    rows = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.substring("text", place, F.lit(STRETCH)).alias("text"))
    found = sorted((str(r[0]), r[1]) for r in draw(rows, n).collect())
    return fit([t for _, t in found])


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, net: Network) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base spans of the kind), base_sha256, spans, n_added.

    ``spans`` lists base and added ones by start, then kind. Null and empty texts have none; every character of
    a text is read, however long it is; repeated rows repeat; other columns are ignored.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        base = [base_spans(t) for t in texts]
        added = [reconcile(t, own, b) if own else [] for t, own, b in zip(texts, found_spans(net, texts), base, strict=True)]
        counts = [[sum(k == kind for _, k, _ in b) for b in base] for kind in range(len(KINDS))]
        columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts)]
        columns += [pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base]), pa.array([listed(sorted(b + a)) for b, a in zip(base, added, strict=True)]), pa.array([len(a) for a in added], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_slice(docs.select("doc_id", "text"), work, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def report(docs: DataFrame) -> DataFrame:
    return find(docs, train(docs))
