"""Script profiles: what counts as a word, noise, a particle or a complex character in a family of scripts."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScriptProfile:
    """Regular expressions in Java syntax. kana stands for the simple letters, kanji for the complex ones."""

    token: str
    noise: str
    kana_word: str
    katakana_word: str
    kanji: str
    single: str
    target: str
    particles: tuple[str, ...]
    lower: bool = False


# Character ranges and particles of the Japanese profile.
JA = ScriptProfile(
    token=r"[一-龯々]+[ぁ-ん]*|[ぁ-ん]+|[ァ-ヴー]+|[A-Za-z0-9]+|[^\s　]",
    noise=r"[、。！？・「」『』（）()\[\]a-zA-Z0-9\s　]",
    kana_word=r"^[ぁ-ん]+$",
    katakana_word=r"^[ァ-ヴー]+$",
    kanji=r"[一-龯]",
    single=r"^[ぁ-ん]$",
    target=r"[぀-ゟ゠-ヿ一-鿿]",
    particles=("が", "を", "に", "へ", "と", "で", "も", "か", "の", "て", "な", "だ", "は"),
)
# The same roles in Latin scripts; accented letters are the complex characters.
LATIN = ScriptProfile(
    token=r"\p{L}+",
    noise=r"[^\p{L}]",
    kana_word=r"^[a-z]+$",
    katakana_word=r"^[A-Z]+$",
    kanji=r"[à-öø-ÿß]",
    single=r"^\p{L}$",
    target=r"\p{L}",
    particles=("the", "of", "and", "de", "la", "und", "die", "que"),
    lower=True,
)
# Accented letters and what stands for them in a reading.
ACCENTS, PLAIN = "àâäáéèêëíîïóôöúùûüñçß", "aaaaeeeeiiiooouuuuncs"
