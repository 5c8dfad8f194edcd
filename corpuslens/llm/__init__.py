"""Training-data operators: quality, URL, leak, neighbour, duplicate, packing, archive, sharding, secret scans."""
