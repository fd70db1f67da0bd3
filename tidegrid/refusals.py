"""What this engine does not do. Each call says so; nothing is made up."""

from __future__ import annotations

REASONS = {
    "drift": "drift needs forcing fields and a validated model, neither of which is here",
    "forcing": "no ocean or wind forcing is connected",
    "bathymetry": "no bathymetry is connected",
    "deep_detector": "no trained detector is here",
    "external_processor": "the external processor is not run from here",
    "catalogue_search": "catalogues are searched outside; give recorded pages to sources",
    "download": "archives are fetched outside; give a folder to sources",
    "segmentation_training": "segmentation models are trained outside; linear heads can be scored here",
    "model_registry": "models are promoted outside",
    "authentication": "there is no server here to authenticate to",
}


class Unavailable(NotImplementedError):
    """A capability that is refused on purpose."""


def unavailable(name: str, *_, **__):
    raise Unavailable(f"{name}: {REASONS[name]}")
