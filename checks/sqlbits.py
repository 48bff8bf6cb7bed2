"""Building blocks of the SQL twins, written independently of the Spark side."""

from __future__ import annotations


def r(x: str, digits: int = 6) -> str:
    return f"(round(CAST({x} AS DOUBLE),{digits})+0.0)"


def i(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def blend(tree_weight: float, c: int) -> str:
    return f"(CAST({1 - tree_weight} AS FLOAT)*n{c}+CAST({tree_weight} AS FLOAT)*t{c})"


def argmax(values: list[str]) -> str:
    a, b, c, d = values
    return (
        f"CASE WHEN {a}>={b} AND {a}>={c} AND {a}>={d} THEN 0 WHEN {b}>={c} AND {b}>={d} THEN 1 WHEN {c}>={d} THEN 2 ELSE 3 END"
    )


def scores(prefix: str, multipliers) -> list[str]:
    return [f"(CAST({m} AS FLOAT)*{prefix}{c})" for c, m in enumerate(multipliers)]


def decided(tree_weight: float, multipliers, where: str = "true", source: str = "fx_pixel") -> str:
    """Pixels of a burn recipe with ``pred``."""
    mixed = ", ".join(f"{blend(tree_weight, c)} AS z{c}" for c in range(4))
    return f"(SELECT *, {argmax(scores('z', multipliers))} AS pred FROM (SELECT *, {mixed} FROM {source} WHERE {where}) zz)"


def iou(tp: str, union: str) -> str:
    return f"CASE WHEN ({union})=0 THEN 1.0 ELSE CAST({tp} AS DOUBLE)/({union}) END"


def counts(n: str = "1") -> dict[str, str]:
    """Aggregates over rows of (truth, pred) weighted by ``n``."""
    s = lambda cond: f"coalesce(sum(CASE WHEN {cond} THEN {n} ELSE 0 END),0)"
    out = {
        "btp": s("truth>0 AND pred>0"),
        "bu": s("truth>0 OR pred>0"),
    }
    for c in (1, 2, 3):
        out[f"i{c}"] = s(f"truth={c} AND pred={c}")
        out[f"u{c}"] = s(f"truth={c} OR pred={c}")
    return out


def score_select(source: str, keys: str = "", n: str = "1", rounded: bool = True, having: str = "") -> str:
    """``keys, IoU_burn, IoU_1..3, mIoU_sev, score`` from (truth, pred) rows."""
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    inner = ", ".join(f"{v} AS {a}" for a, v in counts(n).items())
    mid = f"{iou('btp', 'bu')} AS IoU_burn, " + ", ".join(f"{iou(f'i{c}', f'u{c}')} AS IoU_{c}" for c in (1, 2, 3))
    w = r if rounded else (lambda x: x)
    miou = "((IoU_1+IoU_2+IoU_3)/3)"
    return (
        f"SELECT {k}{w('IoU_burn')} AS IoU_burn, {w('IoU_1')} AS IoU_1, {w('IoU_2')} AS IoU_2, {w('IoU_3')} AS IoU_3, {w(miou)} AS mIoU_sev, "
        f"{w(f'0.35*IoU_burn+0.30*{miou}')} AS score FROM (SELECT {k}{mid} FROM (SELECT {k}{inner} FROM {source} {group}) c1) c2"
    )


def f1(tp: str, fp: str, fn: str) -> str:
    return f"CASE WHEN 2*{tp}+{fp}+{fn}=0 THEN 1.0 ELSE 2.0*{tp}/(2*{tp}+{fp}+{fn}) END"


def binary(truth: str = "truth", pred: str = "pred") -> str:
    s = lambda cond: f"CAST(coalesce(sum(CASE WHEN {cond} THEN 1 ELSE 0 END),0) AS BIGINT)"
    return f"{s(f'{truth}=1 AND {pred}=1')} AS tp, {s(f'{truth}<>1 AND {pred}=1')} AS fp, {s(f'{truth}=1 AND {pred}<>1')} AS fn"


def draw(seed: int, *parts: str) -> str:
    text = "||':'||".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"('0x'||substr(md5({text}),1,15))::BIGINT"


#: Ring vertices without the closing one.
OPEN_RINGS = (
    "(SELECT aoi_id, seq, lon, lat FROM (SELECT *, first_value(lon) OVER w AS lon0, first_value(lat) OVER w AS lat0, max(seq) OVER (PARTITION BY aoi_id, part, ring) AS last"
    " FROM fx_vertex WINDOW w AS (PARTITION BY aoi_id, part, ring ORDER BY seq)) z WHERE NOT (seq=last AND seq>0 AND lon=lon0 AND lat=lat0))"
)
#: Areas that have an open ring.
UNCLOSED = "(SELECT aoi_id FROM fx_vertex GROUP BY aoi_id, part, ring HAVING arg_min(lon,seq)<>arg_max(lon,seq) OR arg_min(lat,seq)<>arg_max(lat,seq))"
