"""DataFrame operators: postings, search and update."""
