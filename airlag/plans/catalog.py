"""Imports every query module so that the registry is complete."""

from airlag.plans import q_prep  # noqa: F401
from airlag.plans import q_profile  # noqa: F401
from airlag.plans import q_model_data  # noqa: F401
from airlag.plans import q_models  # noqa: F401
