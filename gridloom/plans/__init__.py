"""Index domains, distributions and affine index maps, as metadata and as columns."""
