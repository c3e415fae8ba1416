"""Where rows come from and go to: the tracking store, the catalog, upload files."""
