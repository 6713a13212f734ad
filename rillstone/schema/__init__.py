"""Schemas: logical types, derivation, evolution."""
