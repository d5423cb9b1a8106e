"""DataFrame operators: paging, devices, images, merging, duplicates."""
