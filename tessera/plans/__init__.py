"""The registered queries of the engine's operators."""
