from affinity.plans.pipelines import als_pipeline, asr_pipeline, car_pipeline
from affinity.plans.requests import build, predict, recommend, similar

__all__ = ["als_pipeline", "asr_pipeline", "build", "car_pipeline", "predict", "recommend", "similar"]
