"""Operators on cells: stencils, conditioning, routing, accumulation, wetness, masks, statistics."""
