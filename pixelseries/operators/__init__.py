"""DataFrame operators: composites, profiles, masks, grids, sampling, scoring, stitching, layout."""
