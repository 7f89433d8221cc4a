"""Token ids of whole texts by a public tokenizer, at a speed that follows distinct words rather than words.

The tokenizer's pre-tokenizer never joins characters across white space and drops it, and its normalizers (NFC, white
space, lower case) never look across it, so a text's ids are its words' ids in a row. Texts are split at the white space
of ASCII only; a word that holds other white space is encoded by the library as it is.

The distinct words of a batch are looked up in a table of at most KNOWN words, which a worker keeps from task to task and
clears when full; those that are not there are encoded by the library in one call. What the texts have in ids is then
gathered in arrays.

A word of letters, perhaps with punctuation after it, is encoded as these two, for the pre-tokenizer splits there;
the letters are put in lower case first, as the normalizer would. So "Word," and "word" share the costly part. Letters
alone make one pre-token, whose last id alone is that of a token with the end-of-word mark; thus many words can be
encoded in one text and told apart by that mark.

``by_words`` says whether the tokenizer is of this kind; others encode whole texts.
"""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words in a worker's table.
KNOWN = 1_200_000

#: Characters of the longest word kept in the table.
LONGEST = 48

#: The pre-tokenizer's pattern that all this holds for (a fixed value of the public vocabulary file).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Words encoded in one text.
TOGETHER = 4000

#: Punctuation that may follow a word; the apostrophe is left out, as it has rules of its own.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: Letters that have one lower-case letter, whatever is around, and that NFC leaves alone.
_PLAIN = "^[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]+$"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def vocabulary_bits(path: str) -> int:
    """Bits that hold every id of the tokenizer, special tokens included."""
    return max(1, (tokenizer(path).get_vocab_size(with_added_tokens=True) - 1).bit_length())


@cache
def tokenizer(path: str):  # noqa: ANN201
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def by_words(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [x["type"] for x in ((spec.get("normalizer") or {}).get("normalizers") or [])]
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return kinds == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("invert") is True and split.get("behavior") == "Removed" and split.get("pattern", {}).get("Regex") == _PATTERN and spec["model"].get("end_of_word_suffix") == "</w>" and spec.get("post_processor") is None and not any(" " in x["content"] for x in spec["added_tokens"])


def _gather(data: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``data``, which end at ``ends``, in the order ``at``, and where each ends."""
    size = np.diff(ends, prepend=0)
    n = size[at]
    to = np.cumsum(n)
    return data[np.repeat((ends - size)[at] - (to - n), n) + np.arange(to[-1] if len(to) else 0)], to


def _strings(x: pa.Array) -> list[str]:
    return x.to_numpy(zero_copy_only=False).tolist()  # some ten times as fast as to_pylist()


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str) -> None:
        self.of, self.known, self.words = tokenizer(path), {"": b""}, by_words(path)
        vocabulary = self.of.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.of.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        """The same for words of plain lower-case letters."""
        out: list[bytes] = []
        chunks = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for chunk, x in zip(chunks, self.of.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(x.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)] if len(ends) == len(chunk) else self._encode(chunk)
        return out

    def _of_words(self, words: pa.Array, plain: np.ndarray) -> list[bytes]:
        """The ids of distinct words; ``plain``: which of them are plain lower-case letters."""
        texts = _strings(words)
        found = list(map(self.known.get, texts))
        new = np.array([x is None for x in found], bool)
        for kind, encode in ((plain, self._encode_plain), (~plain, self._encode)):
            at = np.flatnonzero(new & kind).tolist()
            for i in range(0, len(at), TOGETHER * 16):
                some = at[i : i + TOGETHER * 16]
                made = encode([texts[j] for j in some])
                if len(self.known) + len(some) > KNOWN:
                    self.known = {"": b""}
                for j, ids in zip(some, made, strict=True):
                    found[j] = ids
                    if len(texts[j]) <= LONGEST:
                        self.known[texts[j]] = ids
        return found

    def __call__(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text; none for a null or empty one."""
        if not self.words:
            return [b for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts) for b in self._encode([t or ""])]
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        whole = words.dictionary
        core = pc.utf8_rtrim(whole, _MARKS)
        plain = pc.match_substring_regex(core, _PLAIN)
        # each distinct word is a plain core or an odd word, and then punctuation or nothing
        keys = pc.if_else(plain, pc.utf8_lower(core), whole).dictionary_encode()
        cut = pc.and_(plain, pc.not_equal(pc.binary_length(core), pc.binary_length(whole))).to_numpy(zero_copy_only=False)
        at = pa.array(np.flatnonzero(cut))
        tails = pa.array([w[len(c) :] for w, c in zip(_strings(whole.take(at)), _strings(core.take(at)), strict=True)], pa.string()).dictionary_encode()
        is_plain = np.zeros(len(keys.dictionary), bool)
        is_plain[keys.indices.to_numpy()] = plain.to_numpy(zero_copy_only=False)
        parts = [*self._of_words(keys.dictionary, is_plain), *self._of_words(tails.dictionary, np.zeros(len(tails.dictionary), bool)), b""]
        both = np.full((len(whole), 2), len(parts) - 1)
        both[:, 0] = keys.indices.to_numpy()
        both[cut, 1] = tails.indices.to_numpy() + len(keys.dictionary)
        ends = np.cumsum([len(x) // 4 for x in parts])
        ids, ends = _gather(np.frombuffer(b"".join(parts), "<u4"), ends, both.ravel())
        offsets, at, out = split.offsets.to_numpy() - split.offsets[0].as_py(), words.indices.to_numpy(), []
        first = 0
        while first < len(texts):  # rows of some million words together: bounds the arrays
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + TOGETHER * 256, "right")) - 1)
            some, to = _gather(ids, ends[1::2], at[offsets[first] : offsets[last]])
            data, to = some.tobytes(), np.append(0, 4 * to)[offsets[first : last + 1] - offsets[first]].tolist()
            out += [data[a:b] for a, b in zip(to[:-1], to[1:], strict=True)]
            first = last
        return out


@cache
def encoder(path: str) -> Encoder:
    """The encoder of a worker, whose table outlives its tasks."""
    return Encoder(path)
