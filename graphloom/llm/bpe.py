"""Operator 1: byte-level BPE through a tokenization automaton.

The merges are compiled, in order of rank, into one deterministic automaton whose
paths are exactly the correct tokenizations. It starts with one state that loops on
every byte. The gadget of the merge ``(u, v) -> w``

* gives every state that has an arc ``u`` an arc ``w``, which leads to where ``v`` leads,
* sends all arcs ``u`` to a copy of their target that lacks the arc ``v``.

All arcs with one label share a target, so a state is a copy of its parent less one
arc; states are stored that way (copy on write) and the whole automaton of n merges
takes O(n) memory. ``accepts`` reads an arc from these tables.

A pre-split word is encoded by table-driven transitions: the longest arcs that the text
allows are taken first, and as the automaton is deterministic the path that reaches the end
is the only one. Decoding emits the byte labels of the arcs.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import by_slice

#: Fixed value: the split of the byte-level pre-tokenizer. ``\s`` is spelled out as Unicode White_Space.
SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Distinct words, and arcs, that a worker remembers before it starts afresh.
MEMORY = 500_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    def __init__(self, base: dict[bytes, int], merges: list[tuple[int, int, int]]):
        size = 1 + max([*base.values(), *(w for _, _, w in merges)])
        self.labels: list[bytes] = [b""] * size
        self.goto = [0] * size
        self.born = [-1] * size
        self.left = [-1] * size
        self.parent, self.removed, self.made = [-1], [-1], [-1]
        for label, token in base.items():
            self.labels[token] = label
        for rank, (u, v, w) in enumerate(merges):
            self._gadget(rank, u, v, w)
        self.longest = max(map(len, self.labels))
        self.trie: dict = {}
        for token, label in enumerate(self.labels):
            if label:
                node = self.trie
                for byte in label:
                    node = node.setdefault(byte, {})
                node[-1] = token
        self.arcs: dict[int, bool] = {}

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        self.labels[w] = self.labels[u] + self.labels[v]
        self.goto[w], self.born[w], self.left[w] = self.goto[v], rank, u
        self.parent.append(self.goto[u])
        self.removed.append(v)
        self.made.append(rank)
        self.goto[u] = len(self.parent) - 1

    def accepts(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc ``token``."""
        made, born = self.made, self.born
        while True:
            if made[state] > born[token]:
                if self.removed[state] == token:
                    return False
                state = self.parent[state]
            elif born[token] < 0:
                return True
            else:
                token = self.left[token]

    def arc(self, state: int, token: int) -> bool:
        """``accepts``, remembered."""
        key = state << 32 | token
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= MEMORY:
                self.arcs.clear()
            found = self.arcs[key] = self.accepts(state, token)
        return found

    def matches(self, word: bytes, at: int) -> list[int]:
        """Tokens that ``word`` goes on with at ``at``, shortest first."""
        found, node = [], self.trie
        for byte in word[at : at + self.longest]:
            node = node.get(byte)
            if node is None:
                break
            token = node.get(-1)
            if token is not None:
                found.append(token)
        return found

    def encode(self, word: bytes) -> list[int]:
        """The word's only accepted path, longest arcs first.

        The automaton is deterministic and one path spells each beginning of the word, so a
        position is reached by one state only and is given up once for all.
        """
        labels, goto, size = self.labels, self.goto, len(word)
        path: list[int] = []
        state, at = 0, 0
        open_arcs = [self.matches(word, 0)]
        given_up: set[int] = set()
        while at < size:
            arcs = open_arcs[-1]
            while arcs:
                token = arcs.pop()
                to = at + len(labels[token])
                if to not in given_up and self.arc(state, token):
                    path.append(token)
                    state, at = goto[token], to
                    open_arcs.append(self.matches(word, at))
                    break
            else:
                if not path:
                    raise ValueError("the word has bytes without arcs")
                given_up.add(at)
                open_arcs.pop()
                at -= len(labels[path.pop()])
                state = goto[path[-1]] if path else 0
        return path


class Words(dict):
    """Token ids, four bytes each, little end first, by pre-split word; filled through the automaton."""

    def __init__(self, automaton: MergeAutomaton, special: dict[str, int]):
        super().__init__()
        self.automaton, self.special = automaton, special

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        ids = [self.special[word]] if word in self.special else self.automaton.encode(word.encode())
        found = self[word] = np.array(ids, "<u4").tobytes()
        return found


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters, vocab = byte_letters(), model["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        base = {bytes([b]): vocab[c] for c, b in letters.items()}
        self.automaton = MergeAutomaton(base, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.labels = {i: x for i, x in enumerate(self.automaton.labels)} | {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = Words(self.automaton, self.special)

    def pieces(self, text: str) -> list[str]:
        """The pre-split words; special tokens stand alone."""
        if self.cut is None or not self.cut.search(text):
            return self.split.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else self.split.findall(part)
        return out

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.words.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def count(self, words: list[str]) -> int:
        """Tokens of these pre-split words together."""
        return sum(map(len, map(self.words.__getitem__, words))) // 4

    def decode(self, ids) -> bytes:
        """The arcs' labels; bytes that are no UTF-8 become U+FFFD."""
        joined = b"".join(map(self.labels.__getitem__, ids))
        try:
            joined.decode()
        except UnicodeDecodeError:
            return joined.decode("utf-8", "replace").encode()
        return joined


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker process; the file is a parameter and lies on every worker."""
    return Codec(path)


def encode_documents(docs: DataFrame, tokenizer: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with token ids added as ``array<int>``; a null text is empty and has no ids."""
    path = tokenizer or default_tokenizer()
    rest = [c for c in docs.columns if c != ids]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        found = _lists([own.encode_bytes(t or "") for t in batch.column(text).to_pylist()])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), found], names=[*rest, ids])

    return by_slice(docs.select(rest), work, _schema(docs, rest) + f", `{ids}` array<int>", text)


def decode_documents(docs: DataFrame, tokenizer: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids`` added; null ids give an empty text."""
    path = tokenizer or default_tokenizer()
    rest = [c for c in docs.columns if c != text]

    def run(batches):
        own = codec(path)
        for batch in batches:
            found = pa.array([own.decode(x or []).decode() for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), found], names=[*rest, text])

    return docs.select(rest).mapInArrow(run, _schema(docs, rest) + f", `{text}` string")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens and the digests of nothing. Further columns of
    ``docs`` are ignored; repeated rows each give a row.
    """
    path = tokenizer or default_tokenizer()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, sha = codec(path), hashlib.sha256
        count, first, second = [], [], []
        for text in batch.column("text").to_pylist():
            ids = own.encode_bytes(text or "")
            count.append(len(ids) // 4)
            first.append(sha(ids).hexdigest())
            second.append(sha(own.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return by_slice(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenised(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``docs`` without the text but with ids, n_tokens and whether decoding gives the text back.

    Null texts are empty: no ids, 0 tokens, exact.
    """
    path = tokenizer or default_tokenizer()
    rest = [c for c in docs.columns if c not in ("text", "ids", "n_tokens", "exact")]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids = [own.encode_bytes(t) for t in texts]
        exact = [own.decode(np.frombuffer(x, "<u4").tolist()) == t.encode() for x, t in zip(ids, texts, strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), _lists(ids), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(exact, pa.bool_())], names=[*rest, "ids", "n_tokens", "exact"])

    return by_slice(docs.select(*rest, "text"), work, ", ".join(filter(None, [_schema(docs, rest), "ids array<int>, n_tokens long, exact boolean"])))


def _lists(ids: list[bytes]) -> pa.Array:
    """Encoded rows as a list array."""
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
