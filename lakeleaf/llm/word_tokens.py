"""Token ids of a lower-casing word BPE vocabulary, with the encodings of frequent words kept."""

from __future__ import annotations

import re
import unicodedata
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .runtime import held

#: Words whose ids one worker keeps, twice over: a full store becomes the older one.
KEPT_WORDS = 800_000
#: Longer words are encoded but not kept.
KEPT_CHARS = 64
_TOGETHER = 1024
_MARKS = ".,;:!?"
#: A full stop or comma that may be part of a longer run of marks, which is encoded as a whole: its neighbours aren't letters, digits or blanks.
_RUN = re.compile(r"[.,](?:(?<!(?:[^\W_]|[ \t-\r])[.,])|(?!(?:[^\W_]|[ \t-\r]|\Z)))").search


class WordEncoder:
    """Encodes as the tokenizers library does without adding special tokens (one that the text spells is that token), for vocabularies that drop white space and end words with </w>.

    Such a vocabulary never looks across white space, so a text's ids are those of its words in order. Only words not seen before go to the library,
    and those of letters alone go many in a call: each of them ends with one word-end token, and where that count is not right they go one by one."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        size = self.model.get_vocab_size(with_added_tokens=True)
        self.ends_word = np.array([(self.model.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        #: Words of late, and those of the time before, from which words that occur again are taken over.
        self.kept: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4")

    def _letters(self, words: list[str]) -> None:
        groups = [words[i : i + _TOGETHER] for i in range(0, len(words), _TOGETHER)]
        for group, found in zip(groups, self.model.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            stops = np.flatnonzero(self.ends_word[ids]) + 1
            if len(stops) == len(group):
                data, at = ids.tobytes(), 0
                for word, stop in zip(group, (4 * stops).tolist(), strict=True):
                    self.kept[word], at = data[at:stop], stop
            else:
                self.kept.update((word, self._ids(word).tobytes()) for word in group)

    def _learn(self, words: set[str]) -> None:
        plain = set(filter(_letters_only, words))
        rest, parts = [], []
        for word in words - plain:
            head = word.rstrip(_MARKS)
            if _letters_only(head):
                parts.append((word, head))
            else:
                rest.append(word)
        plain.update(head for _, head in parts)
        self._letters(sorted(plain.difference(self.kept)))
        kept, tails = self.kept, {}
        for word, found in zip(rest, self.model.encode_batch_fast(rest, add_special_tokens=False) if rest else (), strict=True):
            kept[word] = np.array(found.ids, "<u4").tobytes()
        for word, head in parts:
            tail = word[len(head) :]
            if tail not in tails:
                tails[tail] = self._ids(tail).tobytes()
            kept[word] = kept[head] + tails[tail]

    def _prepare(self, words: set[str]) -> set[str]:
        """Have the ids of all the words in `kept`; returns those that were encoded for it."""
        new = words.difference(self.kept)
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.older, self.kept = self.kept, {"": b""}
            new = words.difference(self.kept)
        known = {word for word in new if word in self.older}
        if known:
            self.kept.update(zip(known, map(self.older.__getitem__, known), strict=True))
            new -= known
        if new:
            self._learn(new)
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers. A word that occurs often in them is looked up once."""
        found = pc.split_pattern(pa.array(map(_spaced, texts), pa.large_string()), " ")
        each = found.values.dictionary_encode()
        words, places = each.dictionary.to_numpy(zero_copy_only=False).tolist(), each.indices.to_numpy()
        new = self._prepare(set(words))
        ids = list(map(self.kept.__getitem__, words))
        for word in new:
            if len(word) > KEPT_CHARS:
                del self.kept[word]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        many = sizes[places]
        stops = np.concatenate(([0], np.cumsum(many)))
        at = np.repeat((np.cumsum(sizes) - sizes)[places] - stops[:-1], many)
        at += np.arange(len(at))
        data = np.frombuffer(b"".join(ids), "<u4")[at].tobytes()
        return [data[a:b] for a, b in pairwise((4 * stops[found.offsets.to_numpy()]).tolist())]


def _letters_only(word: str) -> bool:
    """Whether a word is one run of letters to the library too, which composes and lower-cases it first."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


def _spaced(text: str) -> str:
    """Blanks for ASCII white space, and one before full stops and commas where these stand alone: what else is white space the library itself decides.

    Words that hold a longer run of marks stay whole. A character that turns into a letter and a mark (U+0130 in lower case, others when composed) would make
    one run with a full stop behind it."""
    for c in "\n\t\r\x0b\x0c":
        if c in text:
            text = text.replace(c, " ")
    if text.isascii() or "\u0130" not in text and unicodedata.is_normalized("NFC", text):
        parts, done, run = [], 0, _RUN(text)
        while run:
            start, stop = text.rfind(" ", 0, run.start()) + 1, text.find(" ", run.end())
            parts += text[done:start].replace(".", " .").replace(",", " ,"), text[start : stop if stop >= 0 else None]
            done = stop if stop >= 0 else len(text)
            run = _RUN(text, done)
        parts.append(text[done:].replace(".", " .").replace(",", " ,"))
        text = "".join(parts)
    return text


def word_encoder(path: str) -> WordEncoder:
    return held(("word", path), lambda: WordEncoder(path))
