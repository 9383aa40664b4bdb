"""Plan building blocks that keep operators safe at scale: size checks, distributed
order statistics and distributed running sums."""
