import numpy as np
import pytest

from manyvec.operators import images as I


def gradient(h=48, w=64, c=3):
    y, x = np.mgrid[:h, :w]
    return np.stack([(y * 3 + x * 2 + 40 * k) % 256 for k in range(c)], axis=2).astype(np.uint8)


def page(h=80, w=100):
    out = np.full((h, w, 3), 255, np.uint8)
    for y in range(30, 50, 4):
        out[y : y + 2, 30:70] = 20
    return out


@pytest.mark.parametrize("name", sorted(I.DEGRADATIONS))
@pytest.mark.parametrize("channels", [1, 3])
def test_degradations_change_and_keep_the_size(name, channels):
    image = gradient(c=channels)
    out = I.DEGRADATIONS[name](image, 7)
    assert out.shape == image.shape and out.dtype == np.uint8 and (out != image).any()
    assert (I.DEGRADATIONS[name](image, 7) == out).all()


@pytest.mark.parametrize("name", sorted(I.RESTORATIONS))
def test_restorations_reduce_noise(name):
    flat = np.full((40, 40, 1), 128, np.uint8)
    noisy = I.gaussian_noise(flat, 1, std=20)
    assert I.RESTORATIONS[name](noisy, 0, **({"h": 30} if name == "nlmeans" else {})).std() < noisy.std()


def test_wiener_over_frequencies_keeps_shape():
    assert I.wiener(gradient(), local=False).shape == (48, 64, 3)


def test_jpeg_loses_more_at_low_quality():
    image = gradient()
    error = [np.abs(I.jpeg(image, quality=q).astype(int) - image).mean() for q in (95, 50, 5)]
    assert error[0] < error[1] < error[2]


def test_motion_kernel_is_a_line():
    assert I.motion_kernel(9, 0).sum(axis=1)[4] == pytest.approx(1)
    assert I.motion_kernel(9, 90)[:, 4].sum() == pytest.approx(1)


def test_segmentation():
    image = page()
    white = I.segmented(image, padding=2)
    assert white.shape == image.shape and (white[:20] == 255).all() and (white[30:32, 30:70] == 20).all()
    crop = I.segmented(image, padding=2, mode="crop")
    assert crop.shape[0] < 40 and crop.shape[1] < 60
    blank = np.full((30, 30, 3), 255, np.uint8)
    assert I.segmented(blank) is blank
    with pytest.raises(ValueError):
        I.segmented(image, mode="x")


def test_regions():
    mask = np.zeros((6, 8), bool)
    mask[0, 0] = mask[1, 1] = mask[5, 5:8] = mask[3, 7] = True
    ids = I.labelled(mask)
    assert ids[0, 0] == ids[1, 1] != 0 and len(np.unique(ids)) == 4


def test_pipelines(spark):
    with pytest.raises(ValueError):
        I.Pipeline([("sharpen", {})], I.EVERY)
    with pytest.raises(ValueError):
        I.condition("broken")
    image = gradient()
    rows = spark.createDataFrame([(1, *image.shape, bytearray(image.tobytes()))], I.IMAGE)
    for pipe in (I.condition("clean"), I.condition("degraded", "combined"), I.condition("restored", "jpeg_low", "gaussian"), I.condition("segmented", mode="whiten")):
        out = pipe(rows).collect()[0]
        got = np.frombuffer(out["data"], np.uint8).reshape(out["h"], out["w"], out["c"])
        assert (got == pipe.one(image, 1)).all()


def test_many_images_are_restored_at_once_as_one_by_one(monkeypatch):
    rng, calls = np.random.default_rng(2), []
    shapes = [(8, 8, 1)] * 300 + [(5, 9, 1), (8, 8, 3), (1, 1, 1)] * 3
    pictures = [rng.integers(0, 256, shapes[i]).astype(np.uint8) for i in rng.permutation(len(shapes))]
    monkeypatch.setitem(I.AT_ONCE, I.nlmeans, lambda stack, **options: calls.append(len(stack)) or I.nlmeans_stack(stack, **options))
    small = {"template": 3, "search": 5}
    for steps in ([("gaussian_noise", {"std": 15}), ("nlmeans", small)], [("gaussian_blur", {}), ("gaussian", {}), ("wiener", {})], [("gaussian", {"sigma": 0.7}), ("adaptive", {"mode": "crop"}), ("nlmeans", small)]):
        p = I.Pipeline(steps, I.EVERY)
        for key, (image, got) in enumerate(zip(pictures, p.many(pictures, range(len(pictures))), strict=True)):
            want = p.one(image, key)
            assert got.shape == want.shape and got.dtype == want.dtype and (got == want).all()
    assert len(calls) < 60 and max(calls) * 64 <= I.CELLS  # 618 images
    assert p.many([], []) == []


def test_restored_images_are_dealt_out_and_taken_in_stacks(spark, monkeypatch):
    image = np.arange(64, dtype=np.uint8).reshape(8, 8, 1) * 3
    rows = spark.createDataFrame([(i, 8, 8, 1, bytearray(np.roll(image, i).tobytes())) for i in range(400)], I.IMAGE).coalesce(1)
    p = I.condition("restored", "light_noise", "nlmeans")
    out = p(rows)
    assert out.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    got = {r["id"]: r["data"] for r in out.collect()}
    assert sorted(got) == list(range(400)) and all(bytes(got[i]) == p.one(np.roll(image, i), i).tobytes() for i in range(0, 400, 40))
