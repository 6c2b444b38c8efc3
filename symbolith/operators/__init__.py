"""Registry, checking, reference, condensing and analytics operators."""
