"""Decoders of document bytes, used inside Arrow-batched functions. All of them tolerate damaged input."""
