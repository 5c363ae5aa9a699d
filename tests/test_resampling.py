"""Resampling, colour subsampling and the rasteriser."""

import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from manyvec.functions import glyphs as G
from manyvec.functions import resample as R
from manyvec.operators import images as I


def plain(image, to_width, to_height):
    """The same by matrices, in floating point, rounded after each pass."""
    out = image.astype(float)
    for axis, n in ((1, to_width), (0, to_height)):
        w = np.zeros((n, out.shape[axis]))
        for i, (first, ks) in enumerate(R.weights(out.shape[axis], n)):
            w[i, first : first + len(ks)] = np.array(ks) / R.ONE
        out = np.clip(np.floor((out @ w.T if axis else w @ out) + 0.5), 0, 255)
    return out.astype(int)


@pytest.mark.parametrize("shape, size", [((2, 3), (13, 7)), ((5, 9), (9, 5)), ((12, 10), (3, 4)), ((7, 7), (7, 7)), ((1, 1), (4, 2)), ((30, 4), (5, 11))])
def test_images_are_resampled(spark, shape, size):
    image = np.random.default_rng(1).integers(0, 256, shape)
    df = spark.createDataFrame([(image.tolist(),)], "i array<array<int>>")
    found = np.array(df.select(R.resized(F.col("i"), shape[1], shape[0], *size).alias("r")).first()["r"])
    assert found.shape == size[::-1] and np.abs(found - plain(image, *size)).max() <= (0 if found.size < 40 else 1)
    if shape == size[::-1]:
        assert (found == image).all()


def test_weights_sum_to_one_and_lean_on_near_cells():
    for n_in, n_out in ((3, 13), (40, 7), (7, 7), (1, 9)):
        for first, ks in R.weights(n_in, n_out):
            assert abs(sum(ks) - R.ONE) <= len(ks) and 0 <= first <= n_in - len(ks)
    assert R.cubic(0) == 1 and R.cubic(1) == 0 and R.cubic(2) == 0 and R.cubic(1.5) < 0
    with pytest.raises(ValueError):
        R.weights(0, 3)


def test_flat_colour_survives_subsampling():
    for shape in ((8, 8), (7, 5), (1, 1)):
        flat = np.full(shape, 77)
        assert (I.subsampled(flat) == 77).all() and (I.upsampled(I.subsampled(flat), *shape) == 77).all()
    assert I.subsampled(np.array([[0, 1, 0, 1], [0, 1, 0, 1]])).tolist() == [[0, 1]]  # a half goes down, then up


def test_jpeg_smears_colour_but_not_light():
    image = np.zeros((16, 16, 3), np.uint8)
    image[:, ::2, 0] = 200  # red stripes one pixel wide
    out = I.jpeg(image, quality=95).astype(int)
    difference = out[..., 0] - out[..., 1]
    assert difference[:, ::2].mean() - difference[:, 1::2].mean() < 60  # of 200  # the colour of the stripes is gone
    grey = np.repeat(np.tile([0, 200], (16, 8))[..., None], 3, axis=2).astype(np.uint8)
    assert np.abs(I.jpeg(grey, quality=95).astype(int) - grey).mean() < 8


def test_every_printable_letter_is_drawn():
    printable = [c for c in string.printable if c.isprintable()]
    assert len(printable) == 95 == len(G.STROKES)
    for size in (1, 2, 3, 8):
        masks = {c: G.glyph(c, size) for c in printable}
        assert all(m.shape == (9 * size, 5 * size) and m.any() == (c != " ") for c, m in masks.items())
        assert len({m.tobytes() for m in masks.values()}) == 95, size
    assert (G.glyph("é") == G.glyph("漢")).all() and not any((G.glyph("é") == m).all() for m in (G.glyph(c) for c in printable))
    assert G.text_mask("AB c", 2).shape == (18, 48) and G.text_mask("").shape == (9, 0)


def test_capital_t_looks_like_one():
    assert ["".join(".#"[x] for x in row) for row in G.glyph("T").astype(int)][:7] == ["#####", *["..#.."] * 6]


@pytest.mark.parametrize("text", ["WATERMARK", "", "a long line of any text, cut off at the border {~}"])
def test_watermark_is_red_where_the_text_stands(text):
    image = np.full((40, 80, 3), 200, np.uint8)
    out = I.watermark(image, text=text)
    mask = np.zeros((40, 80), bool)
    drawn = G.text_mask(text)[:20, :60]
    mask[20 : 20 + drawn.shape[0], 20 : 20 + drawn.shape[1]] = drawn
    assert (out[~mask] == 200).all() and (out[mask] == [216, 140, 140]).all()
    assert (I.watermark(np.zeros((3, 3, 1), np.uint8)) <= 76).all()
