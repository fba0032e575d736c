"""Where rows come from: archives, feeds, listings, and the star-schema test tables."""
