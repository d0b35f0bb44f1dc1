"""Letters by script, and their counts in a text.

Counting goes through one table of code points instead of a pattern for each
script: the time does not grow with the number of scripts.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: What does not count: passages in brackets.
ASIDES = re.compile(r"\[[^\]]*\]|\([^)]*\)")
#: Code points (hexadecimal) that are letters of a script, as Java 17's
#: patterns know them (Unicode 13). Tests compare them with those patterns.
LETTERS = {
    "Devanagari": "904-939 93D 950 958-961 971-97F A8F2-A8F7 A8FB A8FD-A8FE",
    "Bengali": "980 985-98C 98F-990 993-9A8 9AA-9B0 9B2 9B6-9B9 9BD 9CE 9DC-9DD 9DF-9E1 9F0-9F1 9FC",
    "Gujarati": "A85-A8D A8F-A91 A93-AA8 AAA-AB0 AB2-AB3 AB5-AB9 ABD AD0 AE0-AE1 AF9",
    "Gurmukhi": "A05-A0A A0F-A10 A13-A28 A2A-A30 A32-A33 A35-A36 A38-A39 A59-A5C A5E A72-A74",
    "Kannada": "C80 C85-C8C C8E-C90 C92-CA8 CAA-CB3 CB5-CB9 CBD CDE CE0-CE1 CF1-CF2",
    "Malayalam": "D04-D0C D0E-D10 D12-D3A D3D D4E D54-D56 D5F-D61 D7A-D7F",
    "Oriya": "B05-B0C B0F-B10 B13-B28 B2A-B30 B32-B33 B35-B39 B3D B5C-B5D B5F-B61 B71",
    "Tamil": "B83 B85-B8A B8E-B90 B92-B95 B99-B9A B9C B9E-B9F BA3-BA4 BA8-BAA BAE-BB9 BD0",
    "Telugu": "C05-C0C C0E-C10 C12-C28 C2A-C39 C3D C58-C5A C60-C61",
    "Latin": (
        "41-5A 61-7A AA BA C0-D6 D8-F6 F8-2B8 2E0-2E4 1D00-1D25 1D2C-1D5C 1D62-1D65 1D6B-1D77 1D79-1DBE "
        "1E00-1EFF 2071 207F 2090-209C 212A-212B 2132 214E 2183-2184 2C60-2C7F A722-A787 A78B-A7BF A7C2-A7CA "
        "A7F5-A7FF AB30-AB5A AB5C-AB64 AB66-AB69 FB00-FB06 FF21-FF3A FF41-FF5A"
    ),
    "Cyrillic": "400-481 48A-52F 1C80-1C88 1D2B 1D78 A640-A66E A67F-A69D",
    "Greek": (
        "370-373 376-377 37A-37D 37F 386 388-38A 38C 38E-3A1 3A3-3E1 3F0-3F5 3F7-3FF 1D26-1D2A 1D5D-1D61 "
        "1D66-1D6A 1DBF 1F00-1F15 1F18-1F1D 1F20-1F45 1F48-1F4D 1F50-1F57 1F59 1F5B 1F5D 1F5F-1F7D 1F80-1FB4 "
        "1FB6-1FBC 1FBE 1FC2-1FC4 1FC6-1FCC 1FD0-1FD3 1FD6-1FDB 1FE0-1FEC 1FF2-1FF4 1FF6-1FFC 2126 AB65"
    ),
    "Arabic": (
        "620-63F 641-64A 66E-66F 671-6D3 6D5 6E5-6E6 6EE-6EF 6FA-6FC 6FF 750-77F 8A0-8B4 8B6-8C7 FB50-FBB1 "
        "FBD3-FD3D FD50-FD8F FD92-FDC7 FDF0-FDFB FE70-FE74 FE76-FEFC 1EE00-1EE03 1EE05-1EE1F 1EE21-1EE22 "
        "1EE24 1EE27 1EE29-1EE32 1EE34-1EE37 1EE39 1EE3B 1EE42 1EE47 1EE49 1EE4B 1EE4D-1EE4F 1EE51-1EE52 "
        "1EE54 1EE57 1EE59 1EE5B 1EE5D 1EE5F 1EE61-1EE62 1EE64 1EE67-1EE6A 1EE6C-1EE72 1EE74-1EE77 "
        "1EE79-1EE7C 1EE7E 1EE80-1EE89 1EE8B-1EE9B 1EEA1-1EEA3 1EEA5-1EEA9 1EEAB-1EEBB"
    ),
    "Cjk": (
        "3005 303B 3400-4DBF 4E00-9FFC F900-FA6D FA70-FAD9 20000-2A6DD 2A700-2B734 2B740-2B81D 2B820-2CEA1 "
        "2CEB0-2EBE0 2F800-2FA1D 30000-3134A"
    ),
    "Armenian": "531-556 559 560-588 FB13-FB17",
    "Balinese": "1B05-1B33 1B45-1B4B",
    "Bopomofo": "3105-312F 31A0-31BF",
    "Cherokee": "13A0-13F5 13F8-13FD AB70-ABBF",
    "Coptic": "3E2-3EF 2C80-2CE4 2CEB-2CEE 2CF2-2CF3",
    "Deseret": "10400-1044F",
    "Ethiopic": (
        "1200-1248 124A-124D 1250-1256 1258 125A-125D 1260-1288 128A-128D 1290-12B0 12B2-12B5 12B8-12BE 12C0 "
        "12C2-12C5 12C8-12D6 12D8-1310 1312-1315 1318-135A 1380-138F 2D80-2D96 2DA0-2DA6 2DA8-2DAE 2DB0-2DB6 "
        "2DB8-2DBE 2DC0-2DC6 2DC8-2DCE 2DD0-2DD6 2DD8-2DDE AB01-AB06 AB09-AB0E AB11-AB16 AB20-AB26 AB28-AB2E"
    ),
    "Georgian": "10A0-10C5 10C7 10CD 10D0-10FA 10FC-10FF 1C90-1CBA 1CBD-1CBF 2D00-2D25 2D27 2D2D",
    "Glagolitic": "2C00-2C2E 2C30-2C5E",
    "Gothic": "10330-10340 10342-10349",
    "Hangul": (
        "1100-11FF 3131-318E A960-A97C AC00-D7A3 D7B0-D7C6 D7CB-D7FB FFA0-FFBE FFC2-FFC7 FFCA-FFCF FFD2-FFD7 "
        "FFDA-FFDC"
    ),
    "Hebrew": "5D0-5EA 5EF-5F2 FB1D FB1F-FB28 FB2A-FB36 FB38-FB3C FB3E FB40-FB41 FB43-FB44 FB46-FB4F",
    "Hiragana": "3041-3096 309D-309F 1B001-1B11E 1B150-1B152",
    "Javanese": "A984-A9B2",
    "Katakana": "30A1-30FA 30FD-30FF 31F0-31FF FF66-FF6F FF71-FF9D 1B000 1B164-1B167",
    "Khmer": "1780-17B3 17D7 17DC",
    "Lao": "E81-E82 E84 E86-E8A E8C-EA3 EA5 EA7-EB0 EB2-EB3 EBD EC0-EC4 EC6 EDC-EDF",
    "Lepcha": "1C00-1C23 1C4D-1C4F",
    "Limbu": "1900-191E",
    "Lisu": "A4D0-A4FD 11FB0",
    "Mongolian": "1820-1878 1880-1884 1887-18A8 18AA",
    "Myanmar": (
        "1000-102A 103F 1050-1055 105A-105D 1061 1065-1066 106E-1070 1075-1081 108E A9E0-A9E4 A9E6-A9EF "
        "A9FA-A9FE AA60-AA76 AA7A AA7E-AA7F"
    ),
    "Nko": "7CA-7EA 7F4-7F5 7FA",
    "Ogham": "1681-169A",
    "Rejang": "A930-A946",
    "Runic": "16A0-16EA 16F1-16F8",
    "Samaritan": "800-815 81A 824 828",
    "Saurashtra": "A882-A8B3",
    "Sinhala": "D85-D96 D9A-DB1 DB3-DBB DBD DC0-DC6",
    "Sundanese": "1B83-1BA0 1BAE-1BAF 1BBA-1BBF",
    "Syriac": "710 712-72F 74D-74F 860-86A",
    "Tagalog": "1700-170C 170E-1711",
    "Thaana": "780-7A5 7B1",
    "Thai": "E01-E30 E32-E33 E40-E46",
    "Tibetan": "F00 F40-F47 F49-F6C F88-F8C",
    "Tifinagh": "2D30-2D67 2D6F",
    "Vai": "A500-A60C A610-A61F A62A-A62B",
    "Yi": "A000-A48C",
}
#: By name, as of equals the first by name counts.
NAMES = sorted(LETTERS)


@lru_cache
def _table() -> np.ndarray:
    """The script of each code point: its place in ``NAMES`` and one more, or 0."""
    out = np.zeros(0x110000, np.uint8)
    for i, name in enumerate(NAMES):
        for part in LETTERS[name].split():
            first, _, last = part.partition("-")
            out[int(first, 16) : int(last or first, 16) + 1] = i + 1
    return out


def main_script(text: str | None) -> str | None:
    """The script with most letters outside brackets, of equals the first by name;
    none without letters."""
    if text is None:
        return None
    if "[" in text or "(" in text:
        text = ASIDES.sub("", text)
    codes = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.bincount(_table()[codes], minlength=len(NAMES) + 1)[1:]
    return NAMES[counts.argmax()] if counts.any() else None
