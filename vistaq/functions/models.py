"""Real models: decoding of images and videos, device and precision, and the adapter of a two-tower model.

The libraries (Pillow, OpenCV, PyTorch, Transformers) are optional and imported
where they are used, on the workers.  ``HubEncoder`` takes other loaders too, so
its batching, padding and error rows are tested with a fake model.
"""

from __future__ import annotations

import io
import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np

from ..schemas import VIDEO_EXTENSIONS, model_kind
from .vectors import unit_rows

#: Tokens to which a text is padded for models of this kind; others pad to the longest of a batch.
PADDED = {"siglip": 64}


def is_video(path: str) -> bool:
    return os.path.splitext(path)[1].lower().removeprefix(".") in VIDEO_EXTENSIONS


def decode_image(path: str, content: bytes) -> Any:
    """An RGB image of the file's bytes."""
    from PIL import Image

    return Image.open(io.BytesIO(content)).convert("RGB")


def first_frame(path: str, content: bytes) -> Any:
    """The first frame of a video as an RGB image; read from the path, as OpenCV takes no bytes."""
    import cv2
    from PIL import Image

    video = cv2.VideoCapture(path)
    try:
        if not video.isOpened():
            raise OSError(f"{path}: no video that can be opened")
        found, frame = video.read()
    finally:
        video.release()
    if not found or frame is None:
        raise OSError(f"{path}: no first frame")
    return Image.fromarray(cv2.cvtColor(frame, cv2.COLOR_BGR2RGB))


def decode(path: str, content: bytes, image: Callable[[str, bytes], Any] = decode_image, video: Callable[[str, bytes], Any] = first_frame) -> Any:
    """An image file, or the first frame of a video, by extension; an Exception instead of raising it."""
    try:
        return (video if is_video(path) else image)(path, content)
    except Exception as e:
        return e


def best_device(torch: Any) -> str:
    """cuda, xpu or mps where it is there, else cpu."""
    if torch.cuda.is_available():
        return "cuda"
    if hasattr(torch, "xpu") and torch.xpu.is_available():
        return "xpu"
    return "mps" if torch.backends.mps.is_available() else "cpu"


def best_precision(torch: Any, device: str) -> Any:
    """Half precision on accelerators, the wider half where it is supported; single on a cpu."""
    if device == "cpu":
        return torch.float32
    if device == "mps":
        return torch.float16
    try:
        wide = getattr(torch, device).is_bf16_supported()
    except Exception:
        wide = False
    return torch.bfloat16 if wide else torch.float16


def load_from_hub(name: str) -> tuple[Any, Any, Callable[[Any], np.ndarray], str]:
    """(model, processor, tensor to array, device) of a published model."""
    import torch
    from transformers import AutoModel, AutoProcessor

    device = best_device(torch)
    model = AutoModel.from_pretrained(name, torch_dtype=best_precision(torch, device), use_safetensors=True).to(device).eval()
    torch.set_grad_enabled(False)
    return model, AutoProcessor.from_pretrained(name, use_fast=True), lambda x: x.float().cpu().numpy(), device


class HubEncoder:
    """A text and image model behind ``functions.encoders.Encoder``.

    ``logit_scale`` and ``logit_bias`` are read from the model where it is loaded.
    A file that can't be decoded gives its error and no vector; a failing
    model call gives its error to the files of that call alone.
    """

    def __init__(self, name: str, width: int, loader: Callable[[str], tuple] = load_from_hub, decoder: Callable[[str, bytes], Any] = decode, threads: int | None = None):
        self.name, self.width, self.loader, self.decoder = name, width, loader, decoder
        self.kind = model_kind(name)
        self.threads = threads or os.cpu_count() or 4
        self.logit_scale: float | None = None
        self.logit_bias: float | None = None
        self._parts: tuple | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_parts": None}  # models are loaded on the workers, never sent

    def load(self) -> None:
        if self._parts is None:
            self._parts = self.loader(self.name)
            model, _, plain, _ = self._parts
            # the models hold the logarithm of the scale
            scale, bias = (getattr(model, k, None) for k in ("logit_scale", "logit_bias"))
            self.logit_scale = None if scale is None else float(np.exp(np.asarray(plain(scale)).ravel()[0]))
            self.logit_bias = None if bias is None else float(np.asarray(plain(bias)).ravel()[0])

    def _inputs(self, **values: Any) -> Any:
        _, processor, _, device = self._parts
        return processor(**values, return_tensors="pt").to(device)

    def texts(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.width), np.float32)
        self.load()
        model, _, plain, _ = self._parts
        padding = {"padding": "max_length", "max_length": PADDED[self.kind]} if self.kind in PADDED else {"padding": True}
        return unit_rows(np.asarray(plain(model.get_text_features(**self._inputs(text=texts, truncation=True, **padding))), np.float32)).astype(np.float32)

    def files(self, paths: list[str], contents: list[bytes]) -> list[np.ndarray | Exception]:
        with ThreadPoolExecutor(self.threads) as pool:
            out: list = list(pool.map(self.decoder, paths, contents))
        good = [i for i, x in enumerate(out) if not isinstance(x, Exception)]
        if good:
            try:
                self.load()
                model, _, plain, _ = self._parts
                made = unit_rows(np.asarray(plain(model.get_image_features(**self._inputs(images=[out[i] for i in good], padding=True))), np.float32)).astype(np.float32)
            except Exception as e:
                made = [e] * len(good)
            for i, v in zip(good, made, strict=True):
                out[i] = v
        return out
