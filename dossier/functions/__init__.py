"""Column functions over text, numbers, codes and dates, all native expressions."""
