"""Token ids of whole texts by the ``tokenizers`` library, word by word.

The tokenizer splits at white space before it merges, so a text's ids are the
ids of its words one after another. Each worker keeps the ids of the words it
has met (about ``MAX_WORDS``, then it keeps those of the texts in hand), which
spares most of the merging. Texts where a word alone could read differently (combining marks,
special tokens) are given to the tokenizer whole.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a worker remembers; bounds its memory, not what is encoded.
MAX_WORDS = 600_000
_MISSES = 50_000

#: ASCII marks (no apostrophe). After letters they are a token of their own in the tokenizer's splitting.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that composing and lower-casing leave as they are.
_SETTLED = re.compile("[a-zß-öø-ÿ]+")
_COMBINING = re.compile("[\u0300-\u037f]")
_SPECIAL = "<|"


def _letters(words: list[str]) -> list[bool]:
    """Which words the tokenizer, which composes and lower-cases first, still reads as letters only (``İ`` becomes a letter and a
    mark). The words hold no spaces, so they are composed and lower-cased as one text."""
    read = unicodedata.normalize("NFC", " ".join(words)).lower().split(" ")
    return [a and b for a, b in zip(map(str.isalpha, words), map(str.isalpha, read), strict=True)] if words else []


def copied(ids: list[bytes], word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids (four bytes each) of a sequence of words, given as places in ``ids``, and where each word's ids end."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    each, begins = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
    size = sizes[word]
    ends = np.cumsum(size)
    return each[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[word] - (ends - size), size)], ends


class WordTokenizer:
    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tok.model)  # the same model for settled letters: no normalising, words parted at spaces
        self.merges.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.tok.encode_special_tokens = special_as_text
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of new words."""
        known, letters = self.known, _letters(words)
        rest = [w for w, only in zip(words, letters, strict=True) if not only]
        stems = [w.rstrip(_MARKS) for w in rest]
        follow = _letters(stems)
        marked = [(w, stem, w[len(stem):]) for w, stem, only in zip(rest, stems, follow, strict=True) if only]
        other = {w for w, only in zip(rest, follow, strict=True) if not only} | {m for *_, m in marked if m not in known}
        todo = [w for w, only in zip(words, letters, strict=True) if only] + [stem for _, stem, _ in marked if stem not in known]
        todo = dict.fromkeys(todo)
        settled = [w for w in todo if _SETTLED.fullmatch(w)]
        for tok, some in ((self.merges, settled), (self.tok, list(todo.keys() - settled) if len(settled) < len(todo) else [])):
            for k in range(0, len(some), _MISSES):
                part = some[k:k + _MISSES]
                ids = np.array(self._batch([" ".join(part)], tok)[0], dtype="<u4")
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) != len(part):  # a letter that the tokenizer reads as more than letters
                    other.update(part)
                    continue
                raw, cuts = ids.tobytes(), (ends * 4).tolist()
                known.update(zip(part, [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
        todo = sorted(other)
        for k in range(0, len(todo), _MISSES):
            part = todo[k:k + _MISSES]
            for w, ids in zip(part, self._batch(part), strict=True):
                known[w] = np.array(ids, dtype="<u4").tobytes()
        for w, stem, marks in marked:
            known[w] = known[stem] + known[marks]

    def _batch(self, texts: list[str], tok=None) -> list[list[int]]:
        return [e.ids for e in (tok or self.tok).encode_batch_fast(texts, add_special_tokens=False)]

    def _of_words(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that may be read word by word: each distinct word is looked up once, its ids are copied to its places."""
        words = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.string())))
        coded = words.flatten().dictionary_encode()
        each = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, each))
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            if len(self.known) > MAX_WORDS:
                self.known = {"": b"", **{w: ids for w, ids in zip(each, found, strict=True) if ids is not None}}
            self._learn([each[k] for k in new])
            for k in new:
                found[k] = self.known[each[k]]
        ids, ends = copied(found, coded.indices.to_numpy())
        ids, cuts = ids.tobytes(), np.r_[0, ends][np.r_[0, np.cumsum(words.value_lengths().to_numpy())]] * 4
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for k in range(0, len(texts), 1000):  # words of so many texts are held at once
            part = texts[k:k + 1000]
            whole = [_SPECIAL in t or _COMBINING.search(t) is not None for t in part]
            ids = iter(self._of_words([t for t, w in zip(part, whole, strict=True) if not w]))
            out += [self.whole(t) if w else next(ids) for t, w in zip(part, whole, strict=True)]
        return out


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str, special_as_text: bool = False) -> WordTokenizer:
    """One tokenizer for each worker process and file."""
    return WordTokenizer(path, special_as_text)
