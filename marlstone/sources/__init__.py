"""Reading repositories, files, manifests and symbols into the logical tables."""
