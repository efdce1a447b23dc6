"""DataFrame transforms; ``by`` always names the tenant columns and may be empty."""
