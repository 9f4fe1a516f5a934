"""Byte-level BPE by prefix sharing, and decoding.

A text's distinct words are laid out as a trie (in sorted order, so that a depth-first walk is a loop with a
stack). The state of a trie node is the last token of the BPE encoding of the prefix that it stands for. A
prefix's last token t is the one token that ends the prefix and may follow the last token of what is before
it; "may follow" means that merging never joins across the border. So a node's state depends on states of
its ancestors only, it is computed once for all words below it, and a word's encoding is read off by
following last tokens back to the root.

Nulls and empty texts encode to no ids. Texts are processed whole. The strings of special tokens found in a text
become their ids, as the tokenizers library does it by default.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .piece_table import SIGNS, Table
from .shared import kept, pieces, small_batches, text_bytes

#: Bytes of text whose pieces are looked up at once.
BLOCK = 4 << 20

#: Words of more letters keep no codes of their prefixes.
LONG = 64
#: End of the Latin letters, all of which every version of Unicode has.
LATIN_END = "\u0250"
#: A word's ids, each followed by a comma; its decoded bytes.
Code = tuple[bytes, bytes]


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Trie:
    """Encoder of words (in byte letters) by one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        letters = byte_letters()
        self.letters = {b: x for b, x in letters.items()}
        back = {x: b for b, x in letters.items()}
        n = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * n
        for word, i in self.ids.items():
            self.bytes[i] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
        for word, i in self.special.items():
            self.bytes[i] = word.encode()
        self.comma = [b"%d," % i for i in range(n)]
        never = len(spec["model"]["merges"]) + 1
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = self.ids[left], self.ids[right], self.ids[left + right]
            self.rank[a, b] = rank
            made.setdefault(c, (a, b, rank))
        # Tokens that have stood at a token's right (left) edge while it was merged, each with the rank at which it was absorbed.
        self.right: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.left: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for i in self.ids.values():
            for side, edge in ((1, self.right), (0, self.left)):
                t, until = i, never
                edge[i].append((t, until))
                while t in made:
                    until, t = made[t][2], made[t][side]
                    edge[i].append((t, until))
        single = set(letters.values())
        self.word_ids = {w: i for w, i in self.ids.items() if i in made or w in single}
        # Tokens that end in these two letters have so many letters at most.
        self.longest: dict[str, int] = {}
        for w in self.word_ids:
            if len(w) > self.longest.get(w[-2:], 0):
                self.longest[w[-2:]] = len(w)
        self.size = [0] * n  # letters of each token
        for w, i in self.word_ids.items():
            self.size[i] = len(w)
        self.follows: dict[int, bool] = {}
        self.n = n

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a, b as they are when it gets their joined letters."""
        for x, x_until in self.right[a]:
            for y, y_until in self.left[b]:
                rank = self.rank.get((x, y))
                # Merges go by rank, of equal ranks the leftmost first.
                if rank is not None and rank < x_until and rank <= y_until:
                    return False
        return True

    def encode(self, words: list[str]) -> dict[str, Code]:
        """Codes of distinct words, walked in sorted order: the stacks hold the states of the current word's prefixes, last tokens and,
        as they follow from an ancestor's, codes. Words of more than LONG letters keep last tokens only, and their codes are read off
        from the end, so that memory is in proportion to a word's length."""
        out: dict[str, Code] = {}
        if len(self.follows) > 1_000_000:
            self.follows.clear()
        comma, token, size = self.comma, self.bytes, self.size
        stack: list[int] = []
        codes: list[Code] = []
        for word, shared in branches([w for w in words if len(w) <= LONG]):
            del stack[shared:], codes[shared:]
            self.walk(word, shared, stack)
            for end in range(shared, len(word)):
                t = stack[end]
                start = end + 1 - size[t]
                if start:
                    text, raw = codes[start - 1]
                    codes.append((text + comma[t], raw + token[t]))
                else:
                    codes.append((comma[t], token[t]))
            out[word] = codes[-1]
        stack = []
        for word, shared in branches([w for w in words if len(w) > LONG]):
            del stack[shared:]
            self.walk(word, shared, stack)
            found, end = [], len(word)
            while end:
                found.append(stack[end - 1])
                end -= size[found[-1]]
            found.reverse()
            out[word] = b"".join([comma[t] for t in found]), b"".join([token[t] for t in found])
        return out

    def walk(self, word: str, shared: int, stack: list[int]) -> None:
        """Appends the last tokens of the prefixes of more than `shared` letters."""
        ids, follows, n, longest = self.word_ids, self.follows, self.n, self.longest.get
        for end in range(shared + 1, len(word) + 1):
            start = end - longest(word[end - 2 : end] if end > 1 else word[:1], 1)
            for start in range(start if start > 0 else 0, end):
                t = ids.get(word[start:end])
                if t is None:
                    continue
                if not start:
                    break
                key = stack[start - 1] * n + t
                ok = follows.get(key)
                if ok is None:
                    ok = follows[key] = self.may_follow(stack[start - 1], t)
                if ok:
                    break
            else:
                raise ValueError(f"no token ends {word[:end]!r}")
            stack.append(t)


def branches(words: list[str]):
    """Words in sorted order, each with the number of letters that it shares with the one before."""
    before = ""
    for word in sorted(words):
        most, shared = min(len(before), len(word)), 0
        while shared < most and before[shared] == word[shared]:
            shared += 1
        yield word, shared
        before = word


class PieceEncoder(Table):
    """Encodes pieces of texts with a trie; remembers ids, each followed by a comma, and decoded bytes of each."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        self.trie = Trie(path)
        self.split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        super().__init__([np.dtype(np.uint8)] * 2, BLOCK)

    def words(self, part: str) -> list[str | int]:
        """Words in byte letters; the id of a special token stands for itself."""
        space = part[:1] == " "
        bare = part[1:] if space else part
        core = bare.rstrip(SIGNS)
        if core.isalpha() and (core.isascii() or max(core) < LATIN_END):  # letters, then signs: words whatever else a pre-tokenizer does
            if not core.isascii():
                core = core.encode().decode("latin-1").translate(self.trie.letters)
                tail = bare[len(bare.rstrip(SIGNS)) :]
            else:
                tail = bare[len(core) :]
            word = "Ġ" + core if space else core
            return [word, tail] if tail else [word]
        if self.trie.cut and self.trie.cut.search(part):
            found: list[str | int] = []
            for x in self.trie.cut.split(part):
                found += [self.trie.special[x]] if x in self.trie.special else [w for w, _ in self.split(x)] if x else []
            return found
        return [w for w, _ in self.split(part)] if part else []

    def codes(self, texts: list[str]) -> list[Code]:
        split = [self.words(x) for x in texts]
        encoded = self.trie.encode(list({w for words in split for w in words if isinstance(w, str)}))
        out = []
        for words in split:
            if len(words) == 1 and words[0] in encoded:
                out.append(encoded[words[0]])
            else:
                codes = [encoded[w] if isinstance(w, str) else (self.trie.comma[w], self.trie.bytes[w]) for w in words]
                out.append((b"".join([c[0] for c in codes]), b"".join([c[1] for c in codes])))
        return out

    def made(self, raw: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        text, at = raw.tobytes(), at.tolist()
        codes = self.codes([text[i:j].decode() for i, j in zip(at[:-1], at[1:], strict=True)])
        return [(np.frombuffer(b"".join(x), np.uint8), np.array([*map(len, x)], np.int64)) for x in zip(*codes, strict=True)]

    def whole(self, raw: bytes) -> list[np.ndarray]:
        [code] = self.codes([raw.decode()])
        return [np.frombuffer(x, np.uint8) for x in code]


def piece_encoder(path: str) -> PieceEncoder:
    return kept(("bpe", path), lambda: PieceEncoder(path))


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text and decodes its ids: per row the id column, the number of tokens, the digest of the decimal ids
    joined by commas, and that of the decoded text in UTF-8.

    A null text is an empty one, with no tokens; a null id stays null; repeated rows stay repeated; an empty table gives an empty
    one. Other columns aren't looked at. No shuffle.
    """

    def run(batches):
        encoder = piece_encoder(tokenizer)
        for batch in batches:
            n, ids_hex, text_hex = [], [], []
            data, offsets = text_bytes(batch.column(1))
            for i, j in pieces(offsets, BLOCK):
                (ids, ids_at), (text, text_at) = encoder.texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids, text, ids_at, text_at = ids.tobytes(), text.tobytes(), ids_at.tolist(), text_at.tolist()
                for k in range(j - i):
                    own = ids[ids_at[k] : ids_at[k + 1]]
                    n.append(own.count(b","))
                    ids_hex.append(hashlib.sha256(own[:-1]).hexdigest())
                    text_hex.append(hashlib.sha256(text[text_at[k] : text_at[k + 1]].decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, SCHEMA)
