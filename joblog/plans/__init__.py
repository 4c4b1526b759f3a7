"""Plan-level building blocks: ordered computations that survive hot keys."""
