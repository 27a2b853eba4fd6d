"""BPE encoding by a tokenization automaton, decoding by its arc labels.

**Compilation.** The automaton reads tokens and accepts exactly the token sequences that BPE
produces. It starts as one state with a loop for every base symbol; the merges are then applied in
order. The gadget of a merge (u, v) copies the state that u leads to, without its v arc, sends all
u arcs to the copy, and adds a uv arc to where v led. Copies share all but the removed arc with their
origin, so a gadget is stored as its pair and its place in the order, and the automaton has at most
one state per merge. ``read`` reads a transition from the gadgets; ``allows`` keeps it in a table.

**Encoding.** A word's symbols are matched against the token trie, longest token first, along arcs
the automaton has. Every prefix of a word has one accepted path only, so each position is visited at
most once. Words come from the vocabulary file's own normalisation and split (NFC, white space to
space, per-character lower case; special tokens first): by the same expression where a stretch is Latin script, by the
library where it is not, as the two know different versions of Unicode. Recent results are kept in bounded tables.

**Decoding.** The labels of the ids' arcs, joined as ``decode(ids, skip_special_tokens=False)`` does
for a file without decoder: with single spaces.

Null or empty texts give no ids and an empty decoded text; rows with null or repeated ``doc_id`` are
encoded each on its own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import array
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Kept, keep, slices

KEPT = 250_000
"""Entries of a table of recent words, in each of two generations."""
LATIN = "\u0250"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


class Automaton:
    """The tokenization automaton of a list of merges over base tokens."""

    def __init__(self, base: list[int], merges: list[tuple[int, int, int]]):
        """``merges``: (left, right, result) token ids in order of priority."""
        self.born = dict.fromkeys(base, -1)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.gadgets: dict[int, int] = {}
        self.table: dict[int, bool] = {}
        for k, (u, v, uv) in enumerate(merges):
            if uv in self.born:
                raise ValueError(f"token {uv} is the result of two merges")
            if u not in self.born or v not in self.born or not self.read(u, v):
                continue  # no accepted sequence holds u before v: the gadget would add nothing
            self.born[uv], self.left[uv], self.right[uv] = k, u, v
            self.gadgets[u << 20 | v] = k

    def read(self, last: int, token: int) -> bool:
        """Whether the state that ``last`` leads to has an arc for ``token``.

        The state of ``last`` as of gadget ``until`` is its origin less the arcs that gadgets on
        ``last`` removed up to then; its origin is the state of the right half when ``last`` was added.
        """
        gadgets, born, until = self.gadgets, self.born, len(self.gadgets) + len(self.born) + 1
        while True:
            k = gadgets.get(last << 20 | token)
            if k is not None and k <= until:
                return False
            if born[last] > born[token]:
                until = born[last] - 1
                last = self.right[last]
            elif born[token] < 0:
                return True
            else:  # when the arc was added, the state got it exactly if it had one for the left half
                until = born[token]
                token = self.left[token]

    def allows(self, last: int, token: int) -> bool:
        key = last << 20 | token
        known = self.table.get(key)
        if known is None:
            if len(self.table) > 500_000:
                self.table.clear()
            known = self.table[key] = self.read(last, token)
        return known


class Tokenizer:
    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre] != ["Split", "ByteLevel"]:
            raise ValueError("this vocabulary file has another normalisation or split")
        self.split = regex.compile(pre[0]["pattern"]["Regex"])
        self.end = model["end_of_word_suffix"]
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        sym = byte_symbols()
        base = [vocab[s + e] for s in sym for e in ("", self.end) if s + e in vocab]
        self.auto = Automaton(base, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if not all("<" in s for s in self.special):
            raise ValueError("this vocabulary file has special tokens of another kind")
        self.special_cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.sym = {chr(i): s for i, s in enumerate(sym)}
        self.labels = np.empty(max([*vocab.values(), *self.special.values()]) + 1, object)
        for s, i in [*vocab.items(), *self.special.items()]:
            self.labels[i] = s.encode()
        # A trie over byte symbols: each node has its children, the id of the token that ends here inside a word, and of the one
        # that ends a word here.
        self.trie: list = [{}, None, None]
        for token, i in vocab.items():
            if i in self.auto.born:
                node, last = self.trie, token.endswith(self.end)
                for c in token.removesuffix(self.end):
                    node = node[0].setdefault(c, [{}, None, None])
                node[1 + last] = i
        self.path, self.library = path, None
        self.words = Kept(KEPT, lambda w: self.word("".join(map(self.sym.__getitem__, w.encode().decode("latin-1")))))
        self.symbols = Kept(KEPT, self.word)
        self.pieces = Kept(KEPT, self.piece)

    def _arcs(self, word: str, at: int) -> list[tuple[int, int]]:
        """Tokens that match at a position as (next position, id), the longest last."""
        out, to, node, n = [], at, self.trie, len(word)
        for c in word[at:]:
            node = node[0].get(c)
            if node is None:
                break
            to += 1
            i = node[2] if to == n else node[1]
            if i is not None:
                out.append((to, i))
        return out

    def word(self, word: str) -> bytes:
        """Ids of one pre-split word given in byte symbols."""
        n, allows = len(word), self.auto.allows
        path: list[int] = []
        stack = [(0, self._arcs(word, 0))]
        seen = {0}
        while True:
            if not stack:
                raise ValueError(f"no accepted token path for {word!r}")
            _, arcs = stack[-1]
            while arcs:
                to, token = arcs.pop()
                if to in seen or path and not allows(path[-1], token):
                    continue
                path.append(token)
                if to == n:
                    return array.array("I", path).tobytes()
                seen.add(to)
                stack.append((to, self._arcs(word, to)))
                break
            else:
                stack.pop()
                if path:
                    path.pop()

    def plain(self, text: str) -> bytes:
        """Ids of a stretch without special tokens."""
        if text.isascii():
            text = text.lower()
            return self.words[text] if text.isalpha() else b"".join([self.words[w] for w in self.split.findall(text)])
        if max(text) < LATIN:
            # Lower case is taken per character, as the vocabulary file's rule does.
            text = "".join(map(str.lower, unicodedata.normalize("NFC", text)))
            return b"".join([self.words[w] for w in self.split.findall(text)])
        # Which code points are letters and how they are folded is the library's own matter beyond Latin script.
        if self.library is None:
            import tokenizers
            self.library = tokenizers.Tokenizer.from_file(self.path)
        folded = self.library.normalizer.normalize_str(text)
        return b"".join([self.symbols[w] for w, _ in self.library.pre_tokenizer.pre_tokenize_str(folded)])

    def piece(self, piece: str) -> bytes:
        if "<" not in piece or not self.special_cut:
            return self.plain(piece)
        parts = [np.array([self.special[s]], "<u4").tobytes() if s in self.special else self.plain(s) for s in self.special_cut.split(piece)]
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers. A space is dropped by the split and never composes, so
        the stretches between spaces are encoded apart."""
        return b"".join(map(self.pieces.__getitem__, text.split(" ")))

    def decode(self, ids: bytes) -> bytes:
        return b" ".join(self.labels[np.frombuffer(ids, "<u4")].tolist())


def tokenizer(path: str) -> Tokenizer:
    return keep(("automaton", path), lambda: Tokenizer(path))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                  output: str = "digests") -> DataFrame:
    """Encode and decode every whole text.

    ``output="digests"``: doc_id, n_tokens, ids_sha256, decoded_sha256; ``output="ids"``: doc_id,
    n_tokens, ids, decoded.
    """
    digests = output == "digests"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [tok.encode(t or "") for t in part.column("text").to_pylist()]
                decoded = [tok.decode(i) for i in ids]
                n = pa.array([len(i) // 4 for i in ids], pa.int64())
                if digests:
                    a = pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string())
                    b = pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())
                else:
                    a = pa.array([np.frombuffer(i, "<u4").astype(np.int64) for i in ids], pa.list_(pa.int64()))
                    b = pa.array([d.decode() for d in decoded], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, a, b], names=names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, " + (
        "ids_sha256 string, decoded_sha256 string" if digests else "ids array<bigint>, decoded string"))
