"""Ids of whole texts from public tokenizers, by pieces that are encoded once and kept by each Python worker.

Cutting a text into pieces is exact only where the model never merges across a cut; each class says why that
holds for its kind of model, and gives texts that it can't vouch for to the tokenizer whole.
"""

from __future__ import annotations

import json
import re

import numpy as np

CACHE_WORDS, CACHE_BYTES = 500_000, 48_000_000  # of a generation of a worker's cache: words, and bytes of words and ids

#: The letters, numbers and blanks of Latin-1 as Unicode has them, for which the plain engine is
#: twice as fast as one that knows all of Unicode.
KINDS = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\s"}


def latin_kinds() -> dict[str, str]:
    import regex

    return {k: "".join(map(re.escape, regex.findall(p, "".join(map(chr, range(256)))))) for k, p in KINDS.items()}


class CachedIds:
    """Ids of texts by pieces. The cache has two generations, bounded by words and bytes, so frequent pieces stay."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def pieces(self, text: str) -> list[str] | None:
        """The text's pieces, or None where it must be encoded whole."""
        raise NotImplementedError

    def whole(self, texts: list[str]) -> list:
        """The ids of each text or piece as little-endian 32-bit integers."""
        raise NotImplementedError

    def joined(self, parts):
        """What a text's pieces make together."""
        return b"".join(parts)

    def size(self, ids) -> int:
        return len(ids)

    def learn(self, words: list[str]) -> None:
        self.new.update(zip(words, self.whole(words), strict=True))

    def encode(self, texts: list[str]) -> list:
        """The ids of each text as little-endian 32-bit integers. All unseen pieces of the texts are encoded
        together, so give some at a time."""
        split = [self.pieces(t) for t in texts]
        words = set().union(*filter(None, split))
        if len(self.new) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.new, self.old, self.held = {}, self.new, 0
        missing = words.difference(self.new)
        if missing:
            self.new.update({w: self.old[w] for w in missing if w in self.old})
            self.learn([w for w in missing if w not in self.old])
            self.held += sum(map(len, missing)) + sum(self.size(self.new[w]) for w in missing)
        known = self.new.__getitem__
        return [self.joined(self.whole([t])) if w is None else self.joined(map(known, w)) for t, w in zip(texts, split, strict=True)]


class WordIds(CachedIds):
    """By the pre-tokens of a byte-level model, which never merges across them; any other model is given the
    whole texts. With ``plain`` the strings of special tokens are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        pre = self.tokenizer.pre_tokenizer
        self.by_word = isinstance(pre, ByteLevel) and pre.use_regex and not pre.add_prefix_space and self.tokenizer.normalizer is None
        if self.by_word:
            import regex

            # Fixed value: the public split pattern of byte-level models; its parts exclude each other but
            # for the last, so words come first for speed
            pattern = " ?{L}+| ?{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
            self.split = regex.compile(re.sub(r"\{(.)\}", lambda m: KINDS[m[1]], pattern)).findall
            narrow, kinds = pattern.replace("{L}+|", "[{L}]+|").replace("{N}+|", "[{N}]+|"), latin_kinds()
            self.split_latin = re.compile(re.sub(r"\{(.)\}", lambda m: kinds[m[1]], narrow)).findall
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str] | None:
        if not self.by_word or any(x in text for x in self.special):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split(text)
        return self.split_latin(text)

    def learn(self, words: list[str]) -> None:
        """Words of a blank and letters are encoded as one text, which splits at the blanks into just these
        words; others one by one."""
        spaced = [w for w in words if w[0] == " " and w[1:].isalpha()]
        if len(spaced) > 1:
            e = self.tokenizer.encode("".join(spaced), add_special_tokens=False)
            ids, owner = np.array(e.ids, "<u4"), np.array(e.word_ids)
            cuts = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
            if len(cuts) == len(spaced) + 1:
                data, edges = ids.tobytes(), (4 * cuts).tolist()
                self.new.update(zip(spaced, (data[a:b] for a, b in zip(edges, edges[1:], strict=False)), strict=True))
                words = [w for w in words if w not in self.new]
        if words:
            super().learn(words)


class FoldedIds(CachedIds):
    """By the words of a model that folds letters, drops white space and splits by one pattern, whose matches
    it then merges each on its own. A text of Latin-1 is its own normal form, and its small letters are those
    of the model, so its folded words share their ids; other texts are cut at white space only. Texts with a
    special token's string or a separator that Python alone takes for white space are encoded whole, as are
    all texts of models of another kind."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        steps = (kind["normalizer"] or {}).get("normalizers", [])
        parts = (kind["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_word = (
            [(x["type"], x.get("pattern"), x.get("content")) for x in steps] == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and parts[0].get("type") == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and r"[^\s\p{L}\p{N}]+" in parts[0]["pattern"].get("Regex", "")
            and [x["type"] for x in parts[1:]] == ["ByteLevel"] and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
        )
        if self.by_word:
            kinds, pattern = latin_kinds(), parts[0]["pattern"]["Regex"]
            for k, p in KINDS.items():
                pattern = pattern.replace(f"[{p}]", f"[{kinds[k]}]").replace(p, kinds[k])
            self.split_latin = re.compile(pattern).findall
        self.other = [*"\x1c\x1d\x1e\x1f", *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str] | None:
        if not self.by_word or any(x in text for x in self.other):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        return self.split_latin(text.lower())


class PieceIds(CachedIds):
    """By the words of a sentencepiece model. A cut before a blank that follows something other than white
    space is exact if no piece of the vocabulary has a blank after another character, since no merge can
    then reach across it; else texts are encoded whole. The model puts a blank before each text, which is
    the blank that the cut took away."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocabulary = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_word = not any("▁" in p.lstrip("▁") for p in self.vocabulary) and [len(self.model.encode(x)) for x in ("", " ")] == [0, 1]
        self.blank = np.array([self.model.piece_to_id("▁")], "<u4").tobytes()
        self.run, self.cut = re.compile(r"\s ").search, re.compile(r"(?<=\S)(?= )").split

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, "<u4").tobytes() for x in self.model.encode(texts, num_threads=1)]

    def pieces(self, text: str) -> list[str] | None:
        if not self.by_word or not text or "▁" in text:
            return None
        if text[0] != " " and not self.run(text):
            return text.split(" ")
        first, *rest = self.cut(f" {text}")
        return [first[1:], *(w[1:] for w in rest)]

    def learn(self, words: list[str]) -> None:
        super().learn([w for w in words if w])
        if "" in words:
            self.new[""] = self.blank  # a last blank, on its own


_loaded: dict[tuple, CachedIds] = {}


def kept(kind: type, *args) -> CachedIds:
    """The tokenizer of this Python worker: loaded once, its cache kept from task to task."""
    if (kind, *args) not in _loaded:
        _loaded[kind, *args] = kind(*args)
    return _loaded[kind, *args]


def word_ids(path: str, plain: bool = False) -> CachedIds:
    return kept(WordIds, path, plain)
