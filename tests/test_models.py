"""Decoding and the model adapter, with a fake model and fake decoders."""

import pickle
import sys
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark import cloudpickle

from vistaq.functions import models
from vistaq.functions.encoders import encode_files


class Inputs(dict):
    def to(self, device):
        self["device"] = device
        return self


def fake_loader(name):
    """A tower that counts what it is given: width 3, scale e^2."""
    said = []

    def processor(**values):
        said.append(values)
        return Inputs(values)

    model = SimpleNamespace(
        logit_scale=np.array(2.0), logit_bias=np.array([-3.0]), said=said,
        get_text_features=lambda text, **_: np.array([[len(t), 1.0, 0.0] for t in text]),
        get_image_features=lambda images, **_: np.array([[0.0, x, 2.0] for x in images]),
    )
    return model, processor, np.asarray, "cpu"


def fake_decoder(path, content):
    return models.decode(path, content, image=lambda p, c: float(int(c)), video=lambda p, c: 100.0)


def encoder(name="hub/siglip2-x"):
    return models.HubEncoder(name, 3, fake_loader, fake_decoder, threads=2)


def test_texts_are_padded_by_kind_and_have_length_one():
    for name, padding in (("hub/siglip2-x", {"padding": "max_length", "max_length": 64}), ("hub/clip-x", {"padding": True})):
        own = encoder(name)
        made = own.texts(["abc", ""])
        assert np.allclose(np.linalg.norm(made, axis=1), 1) and made.dtype == np.float32 and np.allclose(made[1], [0, 1, 0])
        asked = own._parts[0].said[0]
        assert asked["truncation"] is True and {k: asked[k] for k in padding} == padding and ("max_length" in asked) == ("max_length" in padding)
        assert abs(own.logit_scale - np.exp(2.0)) < 1e-9 and own.logit_bias == -3.0
    assert own.texts([]).shape == (0, 3)


def test_a_bad_file_has_its_error_and_a_bad_call_fails_its_batch():
    made = encoder().files(["a.jpg", "b.png", "c.MP4"], [b"1", b"?", b""])
    assert isinstance(made[1], ValueError) and np.allclose(made[0], np.array([0, 1, 2]) / 5**0.5) and np.allclose(made[2][1], 100 / (100**2 + 4) ** 0.5)
    broken = encoder()
    broken.load()
    broken._parts[0].get_image_features = lambda **_: 1 / 0
    assert all(isinstance(x, ZeroDivisionError) for x in broken.files(["a.jpg"], [b"1"]))


def test_a_model_is_loaded_on_the_workers_alone(spark, tmp_path):
    own = encoder()
    own.load()
    assert pickle.loads(pickle.dumps(SimpleNamespace(**{**own.__getstate__(), "loader": None, "decoder": None})))._parts is None
    for name, content in (("a.jpg", b"7"), ("b.jpg", b"not a number")):
        (tmp_path / name).write_bytes(content)
    rows = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.jpg", "b.jpg", "missing.jpg")], "path string")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the fakes travel by value
    found = {r.path.rsplit("/", 1)[1]: r for r in encode_files(rows, "path", own, 2).collect()}
    assert found["a.jpg"].error is None and len(found["a.jpg"].embedding) == 3
    assert found["b.jpg"].embedding is None and found["missing.jpg"].embedding is None and found["b.jpg"].error


def test_device_and_precision():
    no, yes = SimpleNamespace(is_available=lambda: False), SimpleNamespace(is_available=lambda: True, is_bf16_supported=lambda: True)
    old = SimpleNamespace(is_available=lambda: True, is_bf16_supported=lambda: False)
    broken = SimpleNamespace(is_available=lambda: True)
    kinds = {"float32": "f", "float16": "h", "bfloat16": "b"}

    def torch(cuda=no, xpu=no, mps=no):
        return SimpleNamespace(cuda=cuda, xpu=xpu, backends=SimpleNamespace(mps=mps), **kinds)

    for own, device, precision in ((torch(cuda=yes, xpu=yes), "cuda", "b"), (torch(cuda=old), "cuda", "h"), (torch(xpu=yes, mps=yes), "xpu", "b"), (torch(xpu=broken), "xpu", "h"), (torch(mps=yes), "mps", "h"), (torch(), "cpu", "f")):
        assert models.best_device(own) == device and models.best_precision(own, device) == precision


def test_decode_gives_errors_instead_of_raising():
    assert isinstance(models.decode("x.jpg", b"no image"), Exception) and isinstance(models.decode("x.mp4", b""), Exception)
    assert models.is_video("a/b.MOV") and not models.is_video("mov")


def test_a_real_image_if_pillow_is_there(tmp_path):
    image = pytest.importorskip("PIL.Image")
    image.new("L", (3, 2), 7).save(tmp_path / "x.png")
    found = models.decode(str(tmp_path / "x.png"), (tmp_path / "x.png").read_bytes())
    assert found.mode == "RGB" and found.size == (3, 2)
