"""Choices where the blueprint leaves semantics open, in one place.

1. Quadkeys are Web-Mercator tiles, digits from the coarsest level on.
2. Time ranges are half open: [start, end).
3. CSV text knows a delimiter and a backslash escape, no quotes.
4. A trajectory's length is the planar sum of its segments; samples come sorted.
5. Datetimes without zone are read as UTC.
6. Set unions of CSV text come out sorted.
7. Tiles own points half open, so each point has one owner.
8. geodesic_distance is on a sphere of mean radius, as its SQL is, and up to about
   0.6 % off; ellipsoid_distance is on WGS 84, null for nearly antipodal points.
9. bearing counts from north (0) clockwise; gradient counts from south (0) over east.
10. A key column without an order sorts ascending; NONE, which groups only, must be named.
11. Points within 1e-12 of a segment, in proportion to its coordinates, lie on it.
12. A collection that lies in a collection is read flat.
"""

MAX_LATITUDE = 85.0
OUTLIER_KEY = "outliers"
