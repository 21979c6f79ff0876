from tagloom.plans.communities import detect_communities, staged
from tagloom.plans.training import (
    PostModel,
    TagModel,
    fit_post_vectors,
    fit_tag_vectors,
    load_model,
    save_model,
)

__all__ = [
    "PostModel",
    "TagModel",
    "detect_communities",
    "fit_post_vectors",
    "fit_tag_vectors",
    "load_model",
    "save_model",
    "staged",
]
