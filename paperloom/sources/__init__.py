"""Where records come from: feeds, archives, object listings, model calls."""
