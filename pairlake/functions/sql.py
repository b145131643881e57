"""Sample curves as SQL functions. Spark inlines them, so SQL text stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

from pairlake.functions import colour as C

_BODIES = {
    "gamma22": f"CASE WHEN v > 0 THEN pow(v, {1 / C.GAMMA!r}D) ELSE v END",
    "srgb_oetf": "CASE WHEN v > 0.0031308D THEN 1.055D * pow(v, 1 / 2.4D) - 0.055D ELSE v * 12.92D END",
    "pq_oetf": (
        f"pow(({C.PQ_C1!r}D + {C.PQ_C2!r}D * pq_light(v)) / ({C.PQ_C3!r}D * pq_light(v) + 1), {C.PQ_M2!r}D)"
    ),
}
_HELPERS = {
    "pq_video": (
        f"CASE WHEN v < {C.BT709_LINEAR_END!r}D THEN v * 4.5D ELSE 1.099D * pow(v, 0.45D) - 0.099D END"
    ),
    "pq_light": (
        f"pow(100 * pow(greatest(pq_video({C.PQ_SCALE!r}D * v), 0D), {C.BT1886_GAMMA!r}D) / {C.PQ_PEAK!r}D, {C.PQ_M1!r}D)"
    ),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create `gamma22`, `srgb_oetf` and `pq_oetf` in the session."""
    for name, body in {**_HELPERS, **_BODIES}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v DOUBLE) RETURNS DOUBLE RETURN {body}")
    return list(_BODIES)
