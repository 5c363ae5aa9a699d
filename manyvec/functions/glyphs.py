"""Printable ASCII as strokes, and its drawing at any size."""

from __future__ import annotations

import numpy as np

#: fixed values: strokes on a field of 5 columns and 9 rows; capitals stand on row 6, tails reach to row 8. Two digits are
#: a point (column, row), points in a row are a line, a space ends it, a single point is a dot.
STROKES = {
    " ": "", "!": "2024 26", '"': "1012 3032", "#": "1016 3036 0242 0444", "$": "413010010213334445361605 2026", "%": "0640 01 45", "&": "460201102031130405162644", "'": "2022",
    "(": "30212536", ")": "10212516", "*": "2125 0244 0442", "+": "2125 0343", ",": "2617", "-": "0343", ".": "26", "/": "0640",
    "0": "103041453616050110 0541", "1": "112026 1636", "2": "01103041420646", "3": "0110304142334445361605 1333", "4": "3036 300444", "5": "4000023243453606", "6": "30100105163645443303", "7": "004016",
    "8": "103041423313020110 1304051636454433", "9": "43130201103041453616", ":": "22 25", ";": "22 2517", "<": "410345", "=": "0242 0444", ">": "014305", "?": "01103041422324 26",
    "@": "3424132232344541301001051636", "A": "062046 1434", "B": "000636454433 033342413000", "C": "4130100105163645", "D": "00063645413000", "E": "40000646 0333", "F": "400006 0333", "G": "41301001051636454323",
    "H": "0006 4046 0343", "I": "1030 2026 1636", "J": "404536160504", "K": "0006 400346", "L": "000646", "M": "0600234046", "N": "06004640", "O": "103041453616050110",
    "P": "06003041423303", "Q": "103041453616050110 2446", "R": "06003041423303 2346", "S": "413010010213334445361605", "T": "0040 2026", "U": "000516364540", "V": "002640", "W": "0016233640",
    "X": "0046 4006", "Y": "0023 402326", "Z": "00400646", "[": "30101636", "\\": "0046", "]": "10303616", "^": "022042", "_": "0747",
    "`": "1021", "a": "12324346 441405163645", "b": "0006 0312324345361605", "c": "4332120305163645", "d": "4046 4332120305163645", "e": "04444332120305163645", "f": "40302126 0343", "g": "4247381807 4332120305163645",
    "h": "0006 0312324346", "i": "20 2226", "j": "30 32372818", "k": "0006 420446", "l": "10202536", "m": "0206 03122326 23324346", "n": "0206 0312324346", "o": "123243453616050312",
    "p": "0208 0312324345361605", "q": "4248 4332120305163645", "r": "0206 03123243", "s": "4212031434453606", "t": "20253646 0242", "u": "0205163645 4246", "v": "022642", "w": "0216243642",
    "x": "0246 4206", "y": "0226 4218", "z": "02420646", "{": "40302213243646", "|": "2028", "}": "00102233241606", "~": "04133342",
}
COLUMNS, ROWS, ADVANCE = 5, 9, 6
#: What stands for a character that has no strokes.
UNKNOWN = "0040460600"


def glyph(char: str, size: int = 1) -> np.ndarray:
    """A character as a mask of ROWS * size by COLUMNS * size."""
    mask = np.zeros((ROWS * size, COLUMNS * size), bool)
    pen = max(1, size // 2)
    for line in STROKES.get(char, UNKNOWN).split():
        points = np.array([[int(line[i]), int(line[i + 1])] for i in range(0, len(line), 2)], float)
        for a, b in zip(points, points[1:] if len(points) > 1 else points):
            n = int(np.abs(b - a).max() * size) + 1
            for x, y in np.floor(np.linspace(a, b, n) * size).astype(int):
                mask[y : y + pen, x : x + pen] = True
    return mask


def text_mask(text: str, size: int = 1) -> np.ndarray:
    """A line of text as a mask; characters without strokes are boxes."""
    wide = [np.pad(glyph(c, size), ((0, 0), (0, (ADVANCE - COLUMNS) * size))) for c in text]
    return np.concatenate(wide, axis=1) if wide else np.zeros((ROWS * size, 0), bool)
