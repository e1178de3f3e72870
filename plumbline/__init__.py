"""Review-trust analytics as Spark DataFrame operators."""

from plumbline.schema import EXTRA_TYPES, REVIEW_SCHEMA, validate_schema

__all__ = ["EXTRA_TYPES", "REVIEW_SCHEMA", "validate_schema"]
