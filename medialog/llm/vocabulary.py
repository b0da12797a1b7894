"""Vocabulary files: read once by the driver, handed to the tasks as text."""

from __future__ import annotations

from tokenizers import Tokenizer

# Characters on whose class (letter, number, space) and lower case all Unicode versions in use agree.
# Texts with others are handed to the library as they are.
AGREED = "\u0000-՗‐- ぁ-ゖ一-龥가-힣！-～"
# The part of them that composition leaves alone.
COMPOSED = "\u0000-ɏ‐-‧‰-⁞"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return out


# From the Latin-1 reading of UTF-8 bytes to the stand-ins.
TO_SHOWN = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})


def shown(text: str) -> str:
    return text.encode().decode("latin-1").translate(TO_SHOWN)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokenizer(text: str) -> Tokenizer:
    """Of a vocabulary's text. Padding and truncation are off."""
    found = Tokenizer.from_str(text)
    found.no_padding()
    found.no_truncation()
    return found
