"""Global retrieval inside the plan, with a stride and a forecaster."""

from dataclasses import replace

from spark_analog.operators import forecast
from spark_analog.plans import detect as plan
from test_pipeline import H, L, make, settings


def test_global_windows_with_stride_are_a_part_of_all(spark):
    s = settings(mode="global")
    blocked = plan.prepare(make(spark)[0], s)
    model = forecast.linear_forecaster(blocked.where("role = 'base'"), L, H)
    roles = ("score", "test")
    every = plan.global_windows(blocked, s, model, roles).toPandas()
    thin = plan.global_windows(blocked, replace(s, stride=5), model, roles).toPandas()
    key = ["entity", "role", "segment", "channel", "w"]
    assert every["native"].map(len).eq(H).all() and every["candidates"].map(len).eq(3).all()
    by = every.groupby(key[:4])["w"]
    first, last = by.transform("min"), by.transform("max")
    kept = every["role"].ne("test") | ((every["w"] - first) % 5 == 0) | (every["w"] == last)
    a, b = [d.sort_values(key, ignore_index=True) for d in (every[kept], thin)]
    assert a[key].equals(b[key]) and len(thin) < len(every)
    assert (a["nearest"] == b["nearest"]).all() and (a["distance"] - b["distance"]).abs().max() < 1e-12
