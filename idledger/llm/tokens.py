"""Word-cached encoding with a public tokenizer file."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .cluster import kept_by_worker, make_room

#: The part of a word that is looked up without its marks: letters whose NFC form and lower case are per letter.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([^\\w\\s'̀-￿]*)\\Z")
#: Bytes of texts whose words are numbered together, and words whose ids are gathered together: they bound what encoding takes beside its results.
TEXT_BYTES = 8 << 20
GATHERED = 1 << 17
#: Words, and cores of words, that an encoder remembers.
REMEMBERED = 250_000
_ENCODERS: dict[tuple[str, int], WordEncoder] = kept_by_worker()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the rest follow 0x100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = (b for b in range(256) if b not in keep)
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(spare)}


class WordEncoder:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).

    The vocabulary's pre-tokenizer drops white space and no piece spans it, so a text's ids are its
    words' ids in a row. Words are remembered up to a bound; then the memory starts afresh. A word is
    first remembered by its letters alone, and as it stands once they come again. Texts that name a
    special token, and vocabularies of another shape, are encoded as a whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        self.special = [t["content"] for t in shape.get("added_tokens") or []]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.by_word = self._drops_space(shape)
        self.model = self.tokenizer.model
        self.remembered = remembered
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        table = _byte_letters()
        self.letters = {c: "".join(table[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}

    @staticmethod
    def _drops_space(shape: dict) -> bool:
        pre = (shape.get("pre_tokenizer") or {}).get("pretokenizers") or []
        steps = [n.get("type") for n in (shape.get("normalizer") or {}).get("normalizers") or []]
        return (
            steps == ["NFC", "Replace", "Lowercase"]
            and [p.get("type") for p in pre] == ["Split", "ByteLevel"]
            and pre[0].get("behavior") == "Removed"
            and not pre[1].get("add_prefix_space")
        )

    def _keep(self, memory: dict[str, bytes], key: str, ids: bytes) -> bytes:
        if len(memory) >= self.remembered:
            memory.clear()
        memory[key] = ids
        return ids

    def _word(self, word: str) -> bytes:
        got = self.cores.get(word)
        if got is not None:
            return got
        m = _PLAIN.match(word)
        if not m:
            got = self._whole(word)
            return self._keep(self.words, word, got) if len(word) <= 64 else got
        core = m[1].lower()
        got = self.cores.get(core)
        again = got is not None and len(word) <= 64
        if got is None:
            shown = core if core.isascii() else core.translate(self.letters)
            got = self._keep(self.cores, core, array("I", [t.id for t in self.model.tokenize(shown)]).tobytes())
        if m[2]:
            got += self._whole(m[2]) if len(m[2]) > 8 else self._marks(m[2])
        return self._keep(self.words, word, got) if again else got

    def _marks(self, marks: str) -> bytes:
        got = self.cores.get(key := " " + marks)
        return self._keep(self.cores, key, self._whole(marks)) if got is None else got

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers. A null text has none."""
        return list(self.stream(pa.array(texts, pa.large_string())))

    def stream(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """encode() of an Arrow array of strings, one text's ids after the other.

        The texts are taken by TEXT_BYTES, so that memory does not follow their number or mean length;
        a longer text is taken by itself.
        """
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TEXT_BYTES, "right")))
            yield from self._together(texts.slice(low, high - low))
            low = high

    def _together(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The words of all the texts are numbered first, so that each distinct word is looked up once."""
        texts = pc.fill_null(texts, "")
        named = [pc.match_substring(texts, s).to_numpy(zero_copy_only=False) for s in self.special if s] if self.by_word else [np.ones(len(texts), bool)]
        whole = np.logical_or.reduce([np.zeros(len(texts), bool), *named])
        split = pc.ascii_split_whitespace(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        cuts = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        del split
        index = coded.indices.to_numpy(zero_copy_only=False)
        words = coded.dictionary.to_pylist()
        found = list(map(self.words.get, words))
        for i, got in enumerate(found):
            if got is None:
                found[i] = self._word(words[i]) if words[i] else b""
        del coded, words
        ids = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        begins = np.cumsum(sizes) - sizes
        del found
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(cuts, cuts[low] + GATHERED, "right")) - 1)
            near = index[cuts[low] : cuts[high]]
            each = sizes[near]
            ends = np.concatenate(([0], np.cumsum(each)))
            flat = ids[np.repeat(begins[near] - ends[:-1], each) + np.arange(ends[-1])]
            at = ends[cuts[low : high + 1] - cuts[low]].tolist()
            for i in range(low, high):
                yield np.frombuffer(self._whole(texts[i].as_py()), np.uint32) if whole[i] else flat[at[i - low] : at[i - low + 1]]
            low = high


def encoder(path: str | None = None, remembered: int = REMEMBERED) -> WordEncoder:
    """The worker's encoder for this vocabulary; it outlives tasks until another operator needs the room."""
    key = (path or default_vocabulary(), remembered)
    if key not in _ENCODERS:
        make_room(besides=_ENCODERS)
        _ENCODERS[key] = WordEncoder(*key)
    return _ENCODERS[key]
