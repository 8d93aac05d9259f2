from verisift.cli import main

main()
