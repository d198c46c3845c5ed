"""Token ids of the public word vocabulary, the same as its library gives, but quicker.

The library's rules: NFC, lower case, then letters, single digits and runs of symbols as pieces, each
merged as bytes with an end-of-word mark. A piece of plain Latin text is merged by a byte-level merger
whose ranks are the vocabulary's ids, with a space in place of the mark; anything else goes through the
library. Ids of pieces between white space are kept in a bounded table.
"""

from __future__ import annotations

import json
import re

import numpy as np

from amalgam.llm.common import words

TABLE = 400_000
VOCABULARY = "word_bpe_49k.json"
END_OF_WORD = "</w>"
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-įı-ſ]+")
_PIECE = re.compile("[a-zà-öø-ſß]+|[0-9]|[^a-zà-öø-ſß0-9]+")


def _bytes_of_symbols() -> dict[str, int]:
    """The byte that each printable stand-in of byte-level vocabularies means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    def __init__(self, path: str | None = None):
        import tiktoken
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            vocabulary = json.load(f)["model"]["vocab"]
        of = _bytes_of_symbols()
        ranks = {}
        for token, i in vocabulary.items():
            if token.startswith("<|"):
                continue
            ends = token.endswith(END_OF_WORD) and token != END_OF_WORD
            ranks[bytes(of[c] for c in (token[: -len(END_OF_WORD)] if ends else token)) + b" " * ends] = i
        self._merge = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._table: dict[str, bytes] = {}

    def _chunk(self, chunk: str) -> bytes:
        if "<|" in chunk or not _PLAIN.fullmatch(chunk) or len(chunk) > 2000:
            ids = self.library.encode(chunk, add_special_tokens=False).ids
        else:
            ids = self._merge(" ".join(_PIECE.findall(chunk.lower())) + " ")
        return np.array(ids, dtype="<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        table, out = self._table, []
        chunks = words(text)
        try:
            return b"".join([table[c] for c in chunks])
        except KeyError:
            pass
        for c in chunks:
            found = table.get(c)
            if found is None:
                found = self._chunk(c)
                if len(table) < TABLE and len(c) < 40:
                    table[c] = found
            out.append(found)
        return b"".join(out)
