"""DataFrame -> DataFrame steps; each module is one family."""
