"""Small documents that describe things: fitted objects as JSON, robots as URDF, worlds as JSON."""

from __future__ import annotations

import json
import math
import os
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import anomaly, fitted

#: Classes that may be read back; a document can name no other.
KNOWN = {c.__name__: c for c in (
    fitted.StandardScaler, fitted.MinMaxScaler, fitted.MaxAbsScaler, fitted.RobustScaler, fitted.SimpleImputer, fitted.KBinsDiscretizer, fitted.Binarizer, fitted.Normalizer, fitted.QuantileTransform, fitted.OneHotEncoder, fitted.VarianceThreshold, anomaly.HBOS)}


def save_model(model, path: str) -> None:
    """The object's attributes as JSON. States that are tables (of encoders) aren't numbers and are refused."""
    name = type(model).__name__
    if name not in KNOWN:
        raise TypeError(f"{name} can't be kept as a document")
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"class": name, "attributes": vars(model)}, f)


def load_model(path: str):
    """An object as save_model() wrote it. No code of the document runs: it names one of the known classes and plain values."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model = KNOWN[found["class"]].__new__(KNOWN[found["class"]])
    model.__dict__.update(found["attributes"])
    if isinstance(model.state, dict):
        model.state = {k: tuple(v) if isinstance(v, list) and isinstance(model, (fitted._Affine, anomaly.HBOS)) else v for k, v in model.state.items()}
    return model


def _numbers(element, name: str, usual: str) -> list[float]:
    return [float(v) for v in (element.get(name, usual) if element is not None else usual).split()]


def load_urdf(spark: SparkSession, source: str) -> DataFrame:
    """joint, type, parent, child, xyz, rpy, axis, lower, upper: the joints of a robot
    description (a path, or the text itself). A file is one robot, so it is read on the driver. A document type is refused."""
    text = open(source, encoding="utf-8").read() if os.path.exists(source) else source
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("no document types in a robot description")
    rows = []
    for j in ET.fromstring(text).iter("joint"):
        if j.find("parent") is None:
            continue
        limit, origin = j.find("limit"), j.find("origin")
        bound = lambda name, usual: float(limit.get(name, usual)) if limit is not None else usual  # noqa: E731, B023
        rows.append((j.get("name"), j.get("type"), j.find("parent").get("link"), j.find("child").get("link"), _numbers(origin, "xyz", "0 0 0"), _numbers(origin, "rpy", "0 0 0"), _numbers(j.find("axis"), "xyz", "1 0 0"), bound("lower", -math.inf), bound("upper", math.inf)))
    return spark.createDataFrame(rows, "joint string, type string, parent string, child string, xyz array<double>, rpy array<double>, axis array<double>, lower double, upper double")


def load_world(spark: SparkSession, source: str | dict) -> DataFrame:
    """kind, x, y, radius: the objects of a world given as a dictionary, JSON text or a path to it."""
    if isinstance(source, str):
        source = json.load(open(source, encoding="utf-8")) if os.path.exists(source) else json.loads(source)
    rows = [(str(o.get("kind", "circle")), float(o["x"]), float(o["y"]), float(o.get("radius", 0.0))) for o in source.get("objects", [])]
    if any(r[3] < 0 for r in rows):
        raise ValueError("a radius below 0")
    return spark.createDataFrame(rows, "kind string, x double, y double, radius double")
