"""Entity profiles from heterogeneous person records, as lazy DataFrame plans."""

from claimloom.schema import CLAIMS, EDUCATION, EXPERIENCE, METHODS, PROFILE, TRUST, json_schema, trust, trust_for

__version__ = "0.2.0"

__all__ = ["CLAIMS", "EDUCATION", "EXPERIENCE", "METHODS", "PROFILE", "TRUST", "__version__", "json_schema", "trust", "trust_for"]
