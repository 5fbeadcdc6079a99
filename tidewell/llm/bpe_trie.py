"""Byte-level BPE encoding and decoding by a walk over the trie of distinct words (operator 4).

Method. The distinct words of a slice of texts form a trie. The encoding of a prefix is fixed by the last token of its
encoding alone: with last token t it is the encoding of the prefix without t, followed by t. And t is the one suffix
of the prefix that is a token and may follow the last token of what stands before it, that is, encoding the two
tokens' bytes gives these two tokens again. So a depth-first walk of the trie carries one last token for each
depth; words that share a prefix share its states, which are computed once. The walk goes over the sorted words: the
common prefix of neighbours is the path they share, so the trie need not be built out of nodes.

Texts are cut at each single space that a non-space follows, which is always a border between words; Arrow finds the
distinct pieces of a slice, and only those are cut into words by the tokenizer's own pattern.

Defined results: a null text counts as empty and has no ids; text of a special token is that token, as the tokenizers
library has it unless told otherwise; invalid pieces of UTF-8 cannot occur in Arrow strings.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.shared import pick, text_slices, trim

#: The pattern of words and the characters that stand for bytes in byte-level BPE vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Pieces that begin with white space of any kind, or are empty, can join the space before them into one word.
UNSAFE_PIECE = r"^($|[\s\x00-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}])"


def byte_characters() -> dict[str, int]:
    """The character of each byte: printable ones stand for themselves, the others follow from 256 on."""
    out = {chr(b): b for b in PRINTABLE}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(PRINTABLE))})
    return out


class TrieBPE:
    """A byte-level BPE vocabulary whose ids of merged tokens ascend in the order of the merges."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model, byte_of = spec["model"], byte_characters()
        if spec["pre_tokenizer"].get("add_prefix_space") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain byte-level BPE is supported")
        raw = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for k, merge in enumerate(model["merges"]):
            a, b = (bytes(byte_of[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            pair = raw[a], raw[b]
            self.rank[pair] = k
            self.made[k] = raw[a + b]
            self.parts.setdefault(raw[a + b], pair)
        self.bytes_of: list[bytes] = [b""] * (1 + max([*raw.values(), *self.special.values()]))
        for token, i in raw.items():
            self.bytes_of[i] = token
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        # a token that its own merges cannot build is never made
        self.token = {b: i for b, i in raw.items() if len(b) == 1 or i in self.parts}
        self.longest = max(map(len, self.token))
        self._follows: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._words = regex.compile(WORDS)
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merged(self, ids: list[int]) -> list[int]:
        """Apply merges in their order until none fits: the definition of BPE."""
        ids = list(ids)
        while len(ids) > 1:
            best, at = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(ids, ids[1:])))
            if best == 1 << 60:
                break
            ids[at : at + 2] = [self.made[best]]
        return ids

    def follows(self, before: int, after: int) -> bool:
        """Whether encoding the bytes of both tokens gives both tokens."""
        key = before << 32 | after
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) > 600_000:  # bounded memory: start again
                self._follows.clear()
            single = [self.token[bytes([c])] for c in self.bytes_of[before] + self.bytes_of[after]]
            known = self._follows[key] = self.merged(single) == [before, after]
        return known

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of distinct words, by the walk over their trie."""
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list[list[int]] = [[]] * len(words)
        token, follows, known, longest, size = self.token, self.follows, self._follows, self.longest, [len(b) for b in self.bytes_of]
        last: list[int] = [0]  # last[d]: the last token of the encoding of the first d bytes of the path
        path = b""
        for i in order:
            word = words[i]
            shared = 0
            most = min(len(path), len(word))
            if path[:most] == word[:most]:
                shared = most
            else:
                while path[shared] == word[shared]:
                    shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    t = token.get(word[start:end])
                    if t is None:
                        continue
                    if start == 0:
                        if end == 1 or self.whole(t):
                            break
                        continue
                    before = last[start]
                    fits = known.get(before << 32 | t)
                    if fits is None:
                        fits = follows(before, t)
                    if fits:
                        break
                last.append(t)
            ids, d = [], len(word)
            while d:
                t = last[d]
                ids.append(t)
                d -= size[t]
            ids.reverse()
            out[i] = ids
            path = word
        return out

    def whole(self, t: int) -> bool:
        """Whether a token's own bytes encode to it."""
        known = self._whole.get(t)
        if known is None:
            known = self._whole[t] = self.merged([self.token[bytes([c])] for c in self.bytes_of[t]]) == [t]
        return known

    def words_of(self, text: str) -> list[str]:
        return self._words.findall(text)

    def encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids begin (one place more than texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy()
        coded = parts.values.dictionary_encode()
        codes, pieces = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        unsafe = pc.match_substring_regex(pieces, UNSAFE_PIECE).to_numpy(zero_copy_only=False)
        odd = unsafe[codes]
        first = offsets[:-1]
        odd[first] = False
        alone = np.add.reduceat(odd, first) > 0 if len(codes) else np.zeros(n, bool)
        for content in self.special:
            alone |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(alone)

        used = np.zeros(len(pieces), bool)
        keep = np.repeat(~alone, np.diff(offsets))
        begins = np.zeros(len(codes), bool)
        begins[first] = True
        used[codes[keep & ~begins]] = True
        inner, heads, rest = np.flatnonzero(used), np.flatnonzero(~alone), {}
        strings = chain(
            (" " + p for p in pieces.take(inner).to_pylist()),
            parts.values.take(pa.array(first[heads])).to_pylist(),
        )
        number: dict[str, int] = {}
        chunks: list[list[int]] = []
        for s in strings:
            chunks.append([number.setdefault(w, len(number)) for w in self._words.findall(s)])
        for d in whole.tolist():
            row = []
            for k, part in enumerate(self._special.split(texts[d].as_py()) if self._special else [texts[d].as_py()]):
                row += [-1 - self.special[part]] if k % 2 else [number.setdefault(w, len(number)) for w in self._words.findall(part)]
            rest[d] = row
        encoded = self.encode_words([w.encode() for w in number])
        del number

        def ids_of(row: list[int]) -> list[int]:
            if len(row) == 1 and row[0] >= 0:
                return encoded[row[0]]
            return [i for w in row for i in (encoded[w] if w >= 0 else (-1 - w,))]

        lists = [ids_of(row) for row in chunks] + [ids_of(rest[d]) for d in whole.tolist()]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        del lists, chunks

        # the pieces of each text in order, as numbers into lists; texts taken whole have one
        place = np.zeros(len(pieces), np.int64)
        place[inner] = np.arange(len(inner))
        of = place[codes]
        of[first[heads]] = len(inner) + np.arange(len(heads))
        lengths = np.diff(offsets).copy()
        lengths[whole] = 1
        take = np.ones(len(codes), bool)
        if len(whole):
            take = keep.copy()
            take[first[whole]] = True
            of[first[whole]] = len(inner) + len(heads) + np.arange(len(whole))
        of = of[take]
        count = sizes[of]
        ids = flat[np.arange(int(count.sum())) + np.repeat(starts[of] - (np.cumsum(count) - count), count)]
        return ids, np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(lengths)])]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> TrieBPE:
    return TrieBPE(path)


def encode_decode(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, spare: bool = False) -> DataFrame:
    """Encode every text and decode the ids again.

    Returns the id, n_tokens, ids_sha256 (hex of the decimal ids joined by commas) and decoded_sha256 (hex of the
    decoded text in UTF-8); with_ids adds the ids themselves. One pass over the rows, no shuffle; memory is
    bounded by slices of 10 MB of text, or one text that is longer. spare is for workers that other operators use too: slices
    of 3 MB, and what a task has learnt is given back at its end. Null texts count as empty; other columns are ignored.
    """
    schema = f"id {dict(df.dtypes)[id_column]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TrieBPE(vocabulary) if spare else tokenizer(vocabulary)
        for batch in batches:
            for part in text_slices(batch, most_bytes=(3 if spare else 10) << 20):
                ids, at = bpe.encode_slice(part.column(1))
                hashed, decoded = [], []
                ends = at.tolist()
                for a, b in zip(ends, ends[1:]):
                    own = ids[a:b].tolist()
                    hashed.append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, own)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(own).encode()).hexdigest())
                columns = [part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        del bpe
        trim()

    out = df.select(*[c.alias(n) for c, n in zip(pick(df, id_column, text_column), ("id", "text"))]).mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_column), *[c for c in out.columns if c != "id"])
