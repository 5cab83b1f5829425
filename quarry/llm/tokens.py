"""Token ids of whole texts, with a per-worker cache of words."""

from __future__ import annotations

import json
import os

import numpy as np

END_ID = 1
#: What may trail a word as one run of neither letters, digits nor white space (no apostrophe: the patterns know contractions).
_TRAIL = ".,;:!?)]}\"%&$#*|"
#: Last letter of the blocks whose letters and lower case have not changed since before any Unicode version in use.
_LATIN = "\u024f"
_loaded: dict[str, "Encoder"] = {}


class _Words(dict):
    """word -> its ids as bytes; a missing word is encoded when it is first asked for."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        ids = self[word] = self.encode(word)
        return ids


#: What the fast path relies on in a tokenizer file: fixed values, compared with the file as it stands.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def splits_at_spaces(file: dict) -> bool:
    """Whether a tokenizer file is of the kind whose texts may be encoded word by word.

    Nothing composes with, is lower-cased by or is matched across white space under these normalizers and this
    pattern, and a model without dropout encodes each match alone.  Any other file's texts are encoded whole.
    """
    normal, pre, model = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}, file.get("model") or {}
    steps = pre.get("pretokenizers") or [{}]
    split = {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
    return (
        normal.get("normalizers") == _NORMAL
        and len(steps) == 2
        and steps[0] == split
        and steps[1].get("type") == "ByteLevel"
        and not steps[1].get("add_prefix_space")
        and not steps[1].get("use_regex")
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not file.get("truncation")
        and not any(t.get("normalized") or t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in file.get("added_tokens") or ())
    )


class Encoder:
    """Encodes texts exactly as the library does with ``add_special_tokens=False``; a special token's own text is that one id.

    The file decides how (:func:`splits_at_spaces`).  Where it allows, a text's ids are the ids of its words in order, and a word of
    Latin letters with punctuation after them is folded here and handed to the file's model in bytes, as its
    normalizer and splitter would; any other word is encoded whole by the library.  Words are kept in
    bounded caches.  A text that holds the text of a special token is encoded whole.
    """

    def __init__(self, path: str, most_words: int = 900_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = [t["content"] for t in file.get("added_tokens") or ()]
        split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {}
        c = "".join(map(chr, range(0x80, 0x800)))
        self.letters.update(zip(c.encode(), split(c)[0][0]))
        self.parts = _Words(self._part, most_words // 2)
        self.words = _Words(self._word, most_words)
        self.words[""] = b""
        self.by_word = splits_at_spaces(file)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of folded letters."""
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(part)])

    def _word(self, word: str) -> bytes:
        core = word.rstrip(_TRAIL)
        if not core.isalpha() or max(core) > _LATIN:
            return self._whole(word)
        folded = core.lower()
        if not folded.isalpha() or max(folded) > "\u07ff":
            return self._whole(word)
        ids = self.parts[folded]
        return ids + self.words[word[len(core) :]] if len(core) < len(word) else ids

    def encode(self, texts: list) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null counts as empty."""
        get, out = self.words.__getitem__, []
        for t in texts:
            if not t:
                out.append(b"")
            elif self.by_word and not any(s in t for s in self.special):
                out.append(b"".join(map(get, t.replace("\n", " ").split(" "))))
            else:
                out.append(self._whole(t))
        return out


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def slices(batches, most_rows: int = 1000, most_bytes: int = 8 << 20):
    """Arrow batches cut so that neither rows nor bytes of one piece run away."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(most_rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).get_total_buffer_size() and _span(batch, at, n) > most_bytes:
                n //= 2
            yield batch.slice(at, n)
            at += n


def _span(batch, at: int, n: int) -> int:
    return sum(c.slice(at, n).nbytes for c in batch.columns)
