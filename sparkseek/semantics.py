"""Choices that the language leaves to its engine, in one place."""

DEFAULT_LIMIT = 10
GROUP_LIMIT, GROUP_SIZE = 10, 3
HYBRID_FACTOR, HYBRID_UNLIMITED = 10, 100  # candidates of each side of a hybrid query
RRF_K = 2  # score of rank r (from 1): weight / (k + r)
DBSF_SIGMAS = 3.0
DBSF_FLAT = 0.5  # normalised score where a source's scores don't vary
EARTH_RADIUS_M = 6371008.8
BM25_K1, BM25_B, BM25_AVERAGE = 1.2, 0.75, 256.0
DENSE_SIZE, MULTI_SIZE = 384, 96
DENSE, SPARSE, MULTI = "dense", "sparse", "colbert"  # names in collections made by a mode
IMAGE = "image"
#: Payload fields that hold the text, or the image, to embed where none is named, in their order.
TEXT_FIELDS = ("text", "body", "content", "title", "description", "name", "summary", "document")
IMAGE_FIELDS = ("image", "image_path", "image_url", "photo", "picture", "img", "path", "url")
IMPLICIT_FIELDS = TEXT_FIELDS[:3]  # those that alone make an upsert embed without being asked to
LEAST_BUCKETS, BUCKET_BYTES = 16, 512 << 20  # of a stored collection; a change by id rewrites only its buckets
BROADCAST_ROWS = 100_000  # sides that LIMITs bound by more than this are joined by a shuffle
