"""Token ids of whole texts with a public byte-level BPE vocabulary, exact and cached by space-led chunks."""

from __future__ import annotations

#: id that ends every document
END = 2
#: chunks longer than this are encoded each time, and so many are remembered per task
CHUNK_CHARS, CHUNKS = 48, 700_000
#: every white-space character but the plain space
OTHER_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 32]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class _Chunks(dict):
    """Ids by chunk, filled on demand; ``lead`` stands before every chunk."""

    def __init__(self, encode, lead: str):
        self.encode, self.lead = encode, lead

    def __missing__(self, chunk: str) -> bytes:
        from array import array

        ids = array("I", self.encode(self.lead + chunk)).tobytes()
        if len(chunk) <= CHUNK_CHARS:
            self[chunk] = ids
        return ids


class Encoder:
    """``encode(text)`` gives the ids of a text as little-endian unsigned 32-bit bytes.

    The ids are those of ``Tokenizer.from_file(vocabulary).encode(text, add_special_tokens=False)``. The
    word pattern always cuts before a space that stands between two visible characters, so a text is
    cut there and equal chunks are encoded once, with the merges of the same file. Runs of white space
    stay inside a chunk; a text that holds a special string goes through the tokenizer whole.
    """

    def __init__(self, vocabulary: str):
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the file writes each byte as a printable character: those that print stand for themselves
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {
            bytes(byte_of[c] for c in token): i
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()
            if token not in self.special
        }
        merges = tiktoken.Encoding("file", pat_str=word_pattern(), mergeable_ranks=ranks, special_tokens={})
        self.later, self.first = _Chunks(merges.encode_ordinary, " "), _Chunks(merges.encode_ordinary, "")
        self.cut = re.compile(r"(?<=\S) (?=\S)")

    def chunks(self, text: str) -> list[str]:
        parts = text.split(" ")
        if "" in parts or any(s in text and (f" {s}" in text or f"{s} " in text) for s in OTHER_SPACES):
            return self.cut.split(text)
        return parts

    def encode(self, text: str) -> bytes:
        for special in self.special:
            if special in text:
                import numpy as np

                return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        parts = self.chunks(text)
        if len(self.later) + len(self.first) > CHUNKS:
            self.later.clear()
            self.first.clear()
        return self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:]))
