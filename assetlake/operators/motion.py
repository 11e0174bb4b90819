"""Live2D (L2D-02, L2D-04, L2D-07, L2D-09, L2D-10): roles, targets, motions and expressions."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.functions.text import ascii_lower
from assetlake.sources.binary import InvalidData

#: Script classes that have a role.
ROLES = (
    "CubismMoc", "CubismModel", "CubismRenderer", "CubismPhysicsController", "CubismFadeController", "CubismExpressionController", "CubismDisplayInfoParameterName", "CubismDisplayInfoPartName",
    "CubismPosePart", "CubismExpressionData", "CubismExpressionList", "CubismFadeMotionData", "CubismFadeMotionList", "CubismEyeBlinkParameter", "CubismMouthParameter", "CubismParameter", "CubismPart",
)
#: Ids that belong to the model itself, and blend modes by number.
MODEL_IDS, BLENDS = ("Opacity", "EyeBlink", "LipSync"), ("Add", "Multiply", "Overwrite")
LINEAR, BEZIER, STEPPED, INVERSE = 0, 1, 2, 3


def role(class_name: Column) -> Column:
    """JOIN-19: the role of a script class, or null."""
    return F.when(class_name.isin(*ROLES), F.regexp_replace(class_name, "^Cubism", ""))


def roles(behaviours: DataFrame, scripts: DataFrame, script: str, class_name: str) -> DataFrame:
    """L2D-02: behaviours that have a role, by their script."""
    return behaviours.join(scripts, script).withColumn("role", role(F.col(class_name))).filter("role is not null")


def target(curve_id: Column, parameters: Column, parts: Column) -> Column:
    """L2D-09: what a curve drives."""
    return F.when(curve_id.isin(*MODEL_IDS), "Model").when(F.array_contains(parameters, curve_id), "Parameter").when(F.array_contains(parts, curve_id) | ascii_lower(curve_id).contains("part"), "PartOpacity").otherwise("Parameter")


def fallback_group(parameter: Column) -> Column:
    """L2D-10: eye-blink and lip-sync parameters by their names."""
    name = ascii_lower(parameter)
    eye = name.contains("eye") & name.contains("open") & (name.contains("l") | name.contains("r"))
    return F.when(eye, "EyeBlink").when(name.contains("mouth") & name.contains("open") & name.contains("y"), "LipSync")


def segments(keys: list[tuple[float, float, float, float]], force_bezier: bool = False) -> tuple[list[float], int, int]:
    """L2D-07, WIN-01: keys (time, value, in slope, out slope) as a motion's numbers, with the counts of
    segments and points. A short step back to the next key's value takes two keys at once."""
    if not keys:
        raise InvalidData("a curve without keys")
    if any(not math.isfinite(x) for t, v, _, _ in keys for x in (t, v)):
        raise InvalidData("a key that isn't finite")
    out, count, points, i = [keys[0][0], keys[0][1]], 0, 1, 1
    while i < len(keys):
        (t0, v0, _, slope0), (t, v, slope, _) = keys[i - 1], keys[i]
        after = keys[i + 1] if i + 1 < len(keys) else None
        if after and abs(t - t0 - 0.01) < 0.0001 and after[1] == v:
            out += [INVERSE, after[0], after[1]]
            i, points = i + 2, points + 1
        elif math.isinf(slope) and slope > 0:
            out += [STEPPED, t, v]
            i, points = i + 1, points + 1
        elif slope0 == 0 and abs(slope) < 1e-4 and not force_bezier:
            out += [LINEAR, t, v]
            i, points = i + 1, points + 1
        else:
            third = (t - t0) / 3
            out += [BEZIER, t0 + third, v0 + slope0 * third, t - third, v - slope * third, t, v]
            i, points = i + 1, points + 3
        count += 1
    return out, count, points


def motion_json(duration: float, fps: float, fade_in: float, fade_out: float, curves: list[dict], events: list[tuple[float, str]] = ()) -> str:
    """A motion document; curves: Target, Id, FadeInTime, FadeOutTime and keys."""
    rows, count, points = [], 0, 0
    for c in curves:
        numbers, n, p = segments(c["keys"])
        count, points = count + n, points + p
        rows.append({k: c[k] for k in ("Target", "Id", "FadeInTime", "FadeOutTime")} | {"Segments": numbers})
    meta = {
        "Duration": duration, "Fps": fps, "Loop": True, "AreBeziersRestricted": True, "FadeInTime": fade_in, "FadeOutTime": fade_out, "CurveCount": len(rows), "TotalSegmentCount": count,
        "TotalPointCount": points, "UserDataCount": len(events), "TotalUserDataSize": sum(len(v) for _, v in events),
    }
    return json.dumps({"Version": 3, "Meta": meta, "Curves": rows, "UserData": [{"Time": t, "Value": v} for t, v in events]}, indent=2, ensure_ascii=False)


def expression_json(fade_in: float, fade_out: float, parameters: list[tuple[str, float, int]]) -> str:
    """L2D-04: an expression document."""
    if any(not 0 <= b < len(BLENDS) for _, _, b in parameters):
        raise InvalidData("an unknown blend mode")
    rows = [{"Id": i, "Value": v, "Blend": BLENDS[b]} for i, v, b in parameters]
    return json.dumps({"Type": "Live2D Expression", "FadeInTime": fade_in, "FadeOutTime": fade_out, "Parameters": rows}, indent=2, ensure_ascii=False)


def pose_groups(parts: DataFrame, group: str, order: str, part: str) -> DataFrame:
    """AGG-07, L2D-05: the parts of each pose group in their order."""
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(part).alias("p")))), lambda x: x["p"]).alias("parts"))


def packages(models: DataFrame, moc: str, model: str, seq: str) -> DataFrame:
    """JOIN-21: one package for each MOC, in first-seen order, from the last model of it."""
    return models.groupBy(moc).agg(F.min(seq).alias("first_seen"), F.max_by(model, seq).alias(model))
