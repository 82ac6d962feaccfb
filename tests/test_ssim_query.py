from tallyglass.operators import images
from tallyglass.plans import catalog, image_queries  # noqa: F401


def test_side_is_the_default(spark, sf, monkeypatch):
    sides, real = [], images.verify_pairs
    monkeypatch.setattr(images, "verify_pairs", lambda pairs, of, side=256: sides.append(side) or real(pairs, of, side))
    catalog.QUERIES["ssim_verify"](spark, sf)
    assert sides == [256]
